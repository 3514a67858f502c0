"""Fixed values that results depend on: words, labels, codes and thresholds of the decision records.

Words are in canonical form (lower case, without accents) unless said otherwise.
"""

#: Decision-type codes and their labels, as normalised tables show them.
DECISION_TYPES = {
    "Α.1": "Regulatory act",
    "Α.2": "Internal regulation",
    "Β.1.1": "Budget commitment",
    "Β.1.2": "Budget amendment",
    "Β.1.3": "Payment warrant",
    "Β.2.1": "Expenditure approval",
    "Β.2.2": "Payment finalization",
    "Γ.2": "Personnel change",
    "Δ.1": "Procurement assignment",
    "Δ.2.1": "Open procurement notice",
    "Δ.2.2": "Contract award",
    "Δ.2.3": "Contract signing",
    "Δ.2.4": "Procurement cancellation",
    "2.4.7.1": "Other administrative act",
}
#: Decision-type codes and the part a decision plays in a contract's life.
LIFECYCLE_ROLES = {
    "Β.1.1": "commitment",
    "Β.1.3": "payment_order",
    "Β.2.1": "payment",
    "Β.2.2": "payment_correction_or_revocation",
    "Δ.1": "assignment",
    "Δ.2.1": "notice",
    "Δ.2.2": "award",
    "Δ.2.3": "contract",
    "Δ.2.4": "procurement_revocation",
}
#: Words that tell the role where the code does not, in the order they are asked.
ROLE_WORDS = (
    ("invoice", ("τιμολογ", "invoice")),
    ("payment", ("ενταλμα", "πληρωμη", "payment")),
    ("commitment", ("δεσμευση", "αναληψη υποχρεωσης", "commitment")),
    ("contract", ("συμβαση", "contract")),
    ("assignment", ("αναθεση", "award")),
)
#: The roles by which a group's decision is chosen, first to last.
ROLE_ORDER = ("contract", "award", "assignment", "notice", "commitment", "invoice", "payment_order", "payment", "payment_correction_or_revocation", "procurement_revocation")
#: Stages and their phrases, in the order they are asked.
STAGE_PHRASES = (
    ("award", ("ανακηρυξη προσωρινου αναδοχου", "αναδοχος", "κατακυρωση")),
    ("committee", ("συγκροτηση επιτροπης", "ορισμος μελων")),
    ("approval", ("εγκριση", "καταρτιση ορων")),
    ("cancellation", ("ακυρωση", "ανακληση")),
)
#: How much authority a label contained in a decision's type gives it (upper case, as published).
STAGE_AUTHORITY = {
    "ΚΑΤΑΚΥΡΩΣΗ": 10,
    "ΣΥΜΒΑΣΗ": 9,
    "ΕΝΤΟΛΗ ΠΛΗΡΩΜΗΣ": 8,
    "ΟΡΙΣΤΙΚΟΠΟΙΗΣΗ ΠΛΗΡΩΜΗΣ": 7,
    "ΑΝΑΛΗΨΗ ΥΠΟΧΡΕΩΣΗΣ": 6,
    "ΚΑΝΟΝΙΣΤΙΚΗ ΠΡΑΞΗ": 5,
    "ΠΡΑΞΗ ΠΟΥ ΑΦΟΡΑ ΣΕ ΣΥΛΛΟΓΙΚΟ ΟΡΓΑΝΟ - ΕΠΙΤΡΟΠΗ - ΟΜΑΔΑ ΕΡΓΑΣΙΑΣ - ΟΜΑΔΑ ΕΡΓΟΥ - ΜΕΛΗ ΣΥΛΛΟΓΙΚΟΥ ΟΡΓΑΝΟΥ": 5,
    "ΕΓΚΡΙΣΗ ΔΑΠΑΝΗΣ": 4,
    "ΑΝΑΘΕΣΗ ΕΡΓΩΝ / ΠΡΟΜΗΘΕΙΩΝ / ΥΠΗΡΕΣΙΩΝ / ΜΕΛΕΤΩΝ": 8,
    "ΠΕΡΙΛΗΨΗ ΔΙΑΚΗΡΥΞΗΣ": 3,
}
#: Decision types that count as procurement, and those that are direct awards.
PROCUREMENT_TYPES = ("ΑΝΑΘΕΣΗ ΕΡΓΩΝ / ΠΡΟΜΗΘΕΙΩΝ / ΥΠΗΡΕΣΙΩΝ / ΜΕΛΕΤΩΝ", "ΣΥΜΒΑΣΗ", "ΚΑΤΑΚΥΡΩΣΗ", "Procurement assignment", "Contract award")
#: Types of payments, as labelled.
PAYMENT_TYPES = ("Expenditure approval", "Payment finalization", "Payment warrant")
DIRECT_AWARD_TYPES = ("ΑΝΑΘΕΣΗ ΕΡΓΩΝ / ΠΡΟΜΗΘΕΙΩΝ / ΥΠΗΡΕΣΙΩΝ / ΜΕΛΕΤΩΝ", "Procurement assignment")
#: Words of procurement.
PROCUREMENT_WORDS = ("συμβαση", "αναθεση", "προμηθεια", "δαπανη", "contract", "procurement", "award", "supplier")
#: Words of services bought, and of services that recur.
SERVICE_WORDS = ("υπηρεσια", "υπηρεσιων", "εργασια", "εργασιων", "μισθωση", "συντηρηση", "επισκευη", "καθαρισμ", "αποκομιδ", "απορριμματ")
RECURRING_WORDS = ("αποκομιδη", "απορριμματων", "καθαριοτητα", "waste collection", "recurring service")
#: Words of revocation.
REVOCATION_WORDS = ("ανακληση", "ανακαλει", "ανακλητικη", "ακυρωση", "ακυρωνει", "ματαιωση", "revocation", "cancellation")
#: Beginnings of words that tell of payroll and personnel.
PERSONNEL_PHRASES = (
    "συμβαση εργασιας ιδιωτικου δικαιου", "αποζημιωση υπερωρ", "αποζημιωση νυχτ", "μισθοδοσια", "κυρωση μισθοδοτ", "εγκριση αποδοχων",
    "εγκριση μισθοδοσιας", "προνοιακ επιδομα", "προκηρυξη πληρωσης θεσεων", "πινακα επιτυχοντων", "διοριστεων", "ορκωμοσια", "χορηγηση αδειας",
    "αδεια απουσιας", "μετακινηση υπαλληλ", "αποσπαση υπαλληλ", "αναθεση καθηκοντων", "τοποθετηση υπαλληλ", "εκπαιδευτικη αδεια",
    "συνδικαλιστικη αδεια", "αναρρωτικη αδεια", "παραιτηση υπαλληλ", "αυτοδικαιη λυση",
)
#: Beginnings of words that rule procurement out.
NOT_PROCUREMENT = (
    "μειωση εγγυησεων", "επιστροφη εγγυητικης", "συγκροτηση συνεργειου", "συσταση επιτροπης", "απορριψη", "μη εγκριση", "ακυρωση", "ανακληση",
    "ανακλησης", "ανακληση διακηρυξης", "κηρυξη προμηθευτη εκπτωτου", "ακυρωση παραστ",
)
#: What scores a decision for a look at its full record.
DETAIL_TYPES = ("Δ.1", "Δ.2.1", "Δ.2.2", "Δ.2.3", "Β.1.1", "Β.2.1", "Β.2.2", "Β.1.3")
DETAIL_WORDS = ("συμβαση", "αναθεση", "προμηθεια", "δαπανη", "προϋπολογισμ", "αναδοχ", "εκτελεση", "διακηρυξ", "διαγωνισμ", "υπηρεσια", "εργο", "μελετη", "εξοδα", "καυσιμ", "υλικ")
DETAIL_NOISE = (*PERSONNEL_PHRASES, "ακυρωση", "ανακληση", "απορριψη", "μη εγκριση")
DETAIL_PREFIXES = ("Β.1", "Β.2", "Δ.")
#: Financial words as they are written, accents included.
FINANCIAL_WORDS = ("δαπάνη", "δαπανη", "πληρωμή", "πληρωμη", "ανάθεση", "αναθεση", "σύμβαση", "συμβαση", "προμήθεια", "προμηθεια", "τιμολόγ", "τιμολογ", "€", "ευρώ", "ευρω", "contract", "payment", "supplier", "award")
#: Marks of a budget in a subject.
BUDGET_MARKS = ("προυπ", "προυπολογισμου", "προυπολ", "προυπολογισμος", "μελετης", "με φπα")
#: Stems of emergency procurement, and phrases of council procedure, as they are written.
EMERGENCY_STEMS = ("διαπραγμάτευσ", "αδυναμία ανταγωνισμ", "αδυναμια ανταγωνισμ", "μοναδικός προμηθευτ", "μοναδικος προμηθευτ")
PROCEDURE_PHRASES = ("χαρακτηρισμός θέματος", "χαρακτηρισμος θεματος", "ημερήσια διάταξη", "ημερησια διαταξη")
#: Public holidays with a fixed date, month and day.
HOLIDAYS = ("01-01", "01-06", "03-25", "05-01", "08-15", "10-28", "12-25", "12-26")
#: Themes and their words, in the order they are asked.
THEMES = (
    ("digital / IT / software", ("software", "ψηφια", "πληροφορικ", "υπολογισ", "it", "δικτυ", "ιστοσελ")),
    ("culture / festivals / events", ("πολιτισ", "φεστιβαλ", "εκδηλω", "event", "συναυλ")),
    ("fleet / vehicles / spare parts", ("οχημ", "αυτοκινη", "ανταλλακτικ", "ελαστικ", "καυσιμ")),
    ("energy / utilities", ("ενεργ", "ρευμα", "ηλεκτρ", "υδρευση", "φυσικο αεριο")),
    ("food / welfare", ("τροφ", "συσσιτ", "προνοια", "κοινωνικ", "welfare")),
    ("construction / maintenance", ("εργο", "συντηρη", "επισκευ", "κατασκευ", "οδοποι", "κτιρι")),
    ("legal / consulting", ("νομικ", "συμβουλ", "μελετ", "consult")),
    ("cleaning / environment / green spaces", ("καθαριοτ", "απορριμμα", "πρασιν", "περιβαλλον", "ανακυκλ")),
    ("civil protection", ("πολιτικη προστασια", "πυροπροστα", "εκτακτ", "χιον")),
)
#: Categories by words of the title as it is written.
CATEGORIES = (
    ("Procurement / contract", "σύμβαση|συμβαση|ανάθεση|αναθεση|προμήθεια|προμηθεια|contract|procurement"),
    ("Finance / payment", "πληρωμή|πληρωμη|δαπάνη|δαπανη|ένταλμα|ενταλμα|πίστωση|πιστωση|payment|expense"),
    ("Personnel", "προσωπικ|υπάλληλ|υπαλληλ|διορισμ|personnel|staff"),
    ("Permit / license", "άδεια|αδεια|license|permit"),
)
#: Words of a counterparty's kind.
TAX_WORDS = ("δου", "ααδε", "εφορια")
INSURANCE_WORDS = ("εφκα", "ικα", "ετεαεπ", "οαεδ", "δυπα")
AUTHORITY_WORDS = ("υπουργειο", "περιφερεια", "περιφερειας", "αποκεντρωμενη", "αστυνομια", "πυροσβεστικο", "πυροσβεστικη", "νοσοκομειο", "πανεπιστημιο", "κεντρο", "επιμελητηριο", "νπδδ")
#: Letters and words of legal forms.
LEGAL_LETTERS = ("α τ ε", "α ε", "ε π ε", "ο ε", "ι κ ε")
LEGAL_WORDS = (
    "ανωνυμη τεχνικη εταιρεια", "ανωνυμη εταιρεια", "εταιρεια περιορισμενης ευθυνης", "ιδιωτικη κεφαλαιουχικη εταιρεια",
    "ομορρυθμη εταιρεια", "ετερορρυθμη εταιρεια", "τεχνικη εταιρεια", "κατασκευες τεχνικων εργων",
)
#: Names under which a field appears in records, first to last.
SUBJECT_KEYS = ("subject", "title", "summary", "description", "decisionSubject", "documentSubject")
DATE_KEYS = ("issueDate", "decisionDate", "issue_date", "decision_date", "date", "publishDate", "publishedDate")
TYPE_KEYS = ("decisionTypeUid", "decisionTypeId", "decision_type_raw", "decision_type_id", "decisionType", "type")
TYPE_LABEL_KEYS = ("decisionTypeLabel", "decision_type", "decision_type_label", "typeLabel")
URL_KEYS = ("documentUrl", "url", "decisionUrl", "document_url")
SIGNER_KEYS = ("signerName", "signer", "signedBy", "signed_by", "finalSigner", "finalSignerName", "issuerName")
UNIT_KEYS = ("unitName", "unitLabel", "unit", "unitDescription", "organizationalUnit", "organizationalUnitLabel", "organizationUnit", "organizationUnitLabel")
AMOUNT_KEYS = ("amount", "paymentAmount", "expenseAmount", "netAmount", "totalAmount", "amountWithVAT", "budgetAmount")
BUDGET_KEYS = ("budgettype", "budgetType", "budget_source", "budgetSource", "fundingSource", "financingSource")
SUPPLIER_NAME_KEYS = (
    "supplier_name", "supplierName", "supplier", "vendor_name", "vendorName", "vendor", "contractor_name", "contractorName", "contractor",
    "counterparty_name", "counterpartyName", "counterparty", "beneficiary_name", "beneficiaryName", "beneficiary", "recipient_name",
    "recipientName", "recipient", "payee_name", "payeeName", "payee", "contractorTitle", "companyName",
)
SUPPLIER_NAME_LABELS = ("supplier", "vendor", "contractor", "counterparty", "beneficiary", "recipient", "payee", "αναδοχος", "αναδοχου", "προμηθευτης", "προμηθευτη", "δικαιουχος", "δικαιουχου", "επωνυμια")
TAX_ID_LABELS = ("afm", "αφμ", "taxid", "taxnumber", "vatnumber", "vatid", "tin")
AMOUNT_LABELS = ("ποσο", "amount", "paymentamount", "expenseamount")
LABEL_KEYS = ("label", "name", "field", "fieldName", "fieldLabel", "field_label", "key", "title")
VALUE_KEYS = ("value", "fieldValue", "field_value", "values", "amount")
BUDGET_LABELS = ("budgetsource", "fundingsource")
SIGNER_LABELS = ("signer", "signedby", "finalsigner", "υπογραφων", "υπογραφοντα", "υπογραφη")
UNIT_LABELS = ("unit", "unitname", "organizationunit", "organizationalunit", "organizationalunitlabel", "οργανικημοναδα", "οργανωτικημοναδα", "μοναδα", "τμημα", "διευθυνση")
#: Labels of direct awards, competitive awards and contracts in published tables.
DIRECT_LABEL, COMPETITIVE_LABEL, CONTRACT_LABEL = "ΑΝΑΘΕΣΗ", "ΚΑΤΑΚΥΡΩΣΗ", "ΣΥΜΒΑΣΗ"

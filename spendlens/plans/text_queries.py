"""Text, number, date, id and class expressions over documents, orders and order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import dates, ids, numbers, text
from ..functions import vocabulary as V
from .registry import query
from .views import D, O, canonical, decisions, orders


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("txt1_canonical_text", f"SELECT doc_id, md5({canonical('text')}) AS digest, length({canonical('text')}) AS n FROM documents")
def canonical_texts(spark, sf_dir):
    c = text.canonical_text(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(c.cast("binary")).alias("digest"), F.length(c).alias("n"))


@query("txt2_normalize_label", "SELECT page_id, md5(regexp_replace(strip_accents(lower(url)), '[\\s_\\-]+', '', 'g')) AS label FROM pages")
def labels(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text.normalize_label(F.col("url")).cast("binary")).alias("label"))


@query("txt4_compact_text", f"SELECT doc_id, coalesce(nullif(array_to_string(list_slice(string_split({canonical('text')}, ' '), 1, 12), '-'), ''), 'untitled') AS title FROM documents")
def compact(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.compact_text(F.col("text")).alias("title"))


@query("txt5_text_tokens", f"SELECT doc_id, len(list_distinct(list_filter(string_split({canonical('text')}, ' '), lambda t: length(t) >= 4))) AS tokens FROM documents")
def tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.text_tokens(F.col("text"))).cast("long").alias("tokens"))


@query("txt6_supplier_names", "SELECT c_custkey, 'CUSTOMER ' || substr(c_name, 10) || ' ΕΡΓΑ' AS name FROM customer")
def supplier_names(spark, sf_dir):
    form = F.when(F.col("c_custkey") % 4 == 0, " Έργα Α.Ε.").when(F.col("c_custkey") % 4 == 1, " & Έργα ΕΠΕ").when(F.col("c_custkey") % 4 == 2, " και έργα Ο. Ε.").otherwise(" έργα Ανώνυμη Εταιρεία")
    return table(spark, sf_dir, "customer").select("c_custkey", text.canonical_supplier_name(F.concat("c_name", form)).alias("name"))


@query("txt8_person_names", "SELECT c_custkey, c_name || ' ' || c_mktsegment AS name FROM customer")
def person_names(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", text.clean_person_name(F.concat(F.col("c_name"), F.lit(" ,, "), F.col("c_mktsegment"), F.lit(","))).alias("name"))


@query("txt10_listing_text", "SELECT doc_id, substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 120) AS listing FROM documents")
def listings(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.listing_text(F.col("text"), 120).alias("listing"))


def _european(amount):
    """1.234.567,89"""
    return F.translate(F.format_number(amount, 2), ".,", ",.")


@query("num1_parse_amount", "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 3 THEN round(o_totalprice / 1000) * 1000 + 1000 WHEN 4 THEN NULL ELSE o_totalprice END AS amount FROM orders")
def parse_amounts(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("k", F.col("o_orderkey") % 5)
    plain = F.format_string("%.2f", F.col("o_totalprice"))
    thousands = F.regexp_replace(_european(F.round(F.col("o_totalprice") / 1000) * 1000 + 1000), ",00$", "")
    written = F.when(F.col("k") == 0, F.concat(F.lit("€ "), _european(F.col("o_totalprice")))).when(F.col("k") == 1, F.translate(plain, ".", ",")).when(F.col("k") == 2, plain).when(F.col("k") == 3, thousands).otherwise("none")
    return o.select("o_orderkey", numbers.parse_amount(written).alias("amount"))


@query("num2_plain_amount", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE o_totalprice END AS amount FROM orders")
def plain_amounts(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("k", F.col("o_orderkey") % 3)
    comma = F.translate(F.format_string("%.2f", F.col("o_totalprice")), ".", ",")
    written = F.when(F.col("k") == 0, F.format_string('{"amount": %.2f, "currency": "EUR"}', F.col("o_totalprice"))).when(F.col("k") == 1, comma).otherwise("1.234,56")
    return o.select("o_orderkey", numbers.plain_amount(written).alias("amount"))


@query("num3_budget_in_subject", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 AND o_totalprice BETWEEN 1 AND 10000000 THEN greatest(o_totalprice, 12.5) END AS amount FROM orders")
def budgets(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    subject = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "Έργο, προϋπολογισμού ").otherwise("Αρ. πρωτ. "), _european(F.col("o_totalprice")), F.lit(" (12,50 ανά ώρα, 4711 θέσεις)"))
    return o.select("o_orderkey", numbers.budget_in_subject(subject).alias("amount"))


@query("num4_euro_amount", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 1 THEN o_totalprice END AS amount FROM orders")
def euros(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("k", F.col("o_orderkey") % 3)
    e = _european(F.col("o_totalprice"))
    written = F.when(F.col("k") == 0, F.concat(F.lit("ΑΔΑ 77, ποσού "), e, F.lit(" €, άρθρο 3"))).when(F.col("k") == 1, F.concat(F.lit("αξίας EUR "), e)).otherwise(F.concat(F.lit("θέση 12 "), e, F.lit(" ΕΥΡΩ")))
    return o.select("o_orderkey", numbers.euro_amount(written).alias("amount"))


@query("num5_amount_bucket", "SELECT CASE WHEN o_orderstatus = 'P' THEN 'noamount' ELSE CAST(CAST(round_even(o_totalprice * 100, 0) AS BIGINT) AS VARCHAR) END AS bucket, count(*) AS orders FROM orders GROUP BY 1")
def buckets(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("a", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")))
    return o.groupBy(numbers.amount_bucket(F.col("a")).alias("bucket")).agg(F.count("*").alias("orders"))


@query("num6_number_or", "SELECT l_shipmode, round(sum(x), 2) AS total FROM (SELECT l_returnflag AS l_shipmode, CASE l_linenumber WHEN 1 THEN 0 WHEN 2 THEN 0 ELSE l_tax END AS x FROM lineitem) GROUP BY 1")
def safe_numbers(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    written = F.when(F.col("l_linenumber") == 1, "n/a").when(F.col("l_linenumber") == 2, "NaN").otherwise(F.col("l_tax").cast("string"))
    return li.groupBy(F.col("l_returnflag").alias("l_shipmode")).agg(F.round(F.sum(numbers.number_or(written)), 2).alias("total"))


DATES = "CASE o_orderkey % 6 WHEN 5 THEN NULL ELSE CAST(o_orderdate AS DATE) END"


@query("dat2_mixed_dates", f"SELECT o_orderkey, {DATES} AS issue_date, year({DATES}) AS year, month({DATES}) AS month, day({DATES}) AS day, isodow({DATES}) - 1 AS weekday, strftime({DATES}, '%m-%d') AS mmdd FROM orders")
def mixed_dates(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumns({"k": F.col("o_orderkey") % 6, "t": F.col("o_orderdate").cast("timestamp")})
    written = F.coalesce(*[F.when(F.col("k") == i, F.date_format("t", f)) for i, f in enumerate(dates.FORMATS)], F.when(F.col("k") == 4, F.unix_millis("t").cast("string")), F.lit("unknown"))
    return dates.with_calendar(o.select("o_orderkey", dates.mixed_date(written).alias("issue_date")))


@query("dat6_month_windows", """WITH m AS (SELECT unnest(generate_series(date_trunc('month', min(o_orderdate)), date_trunc('month', max(o_orderdate)), INTERVAL 1 MONTH))::DATE AS s FROM orders),
w AS (SELECT s, unnest(generate_series(s, last_day(s), INTERVAL 7 DAYS))::DATE AS window_start FROM m), e AS (SELECT window_start, least(last_day(s), window_start + 6) AS window_end FROM w)
SELECT window_start, CAST(window_end AS DATE) AS window_end, count(o_orderkey) AS orders FROM e LEFT JOIN orders ON CAST(o_orderdate AS DATE) BETWEEN window_start AND window_end GROUP BY ALL""")
def month_windows(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day"))
    ends = o.agg(F.min("day").cast("string").alias("a"), F.max("day").cast("string").alias("b")).first()
    w = dates.month_windows(dates.month_spine(spark, ends.a, ends.b))
    # A day falls into one window, which its month and its day of the month give.
    at = o.withColumn("window_start", F.expr("date_add(trunc(day, 'MM'), cast(floor((dayofmonth(day) - 1) / 7) * 7 as int))")).groupBy("window_start").agg(F.count("*").alias("orders"))
    return w.join(at, "window_start", "left").select("window_start", "window_end", F.coalesce("orders", F.lit(0)).alias("orders"))


@query("dat7_previous_month", "SELECT date_trunc('month', CAST(o_orderdate AS DATE) - INTERVAL 1 MONTH)::DATE AS first_day, last_day((date_trunc('month', o_orderdate) - INTERVAL 1 DAY)::DATE) AS last_day, count(*) AS orders FROM orders GROUP BY ALL")
def previous_months(spark, sf_dir):
    a, b = dates.previous_month(F.col("o_orderdate").cast("date"))
    return table(spark, sf_dir, "orders").groupBy(a.alias("first_day"), b.alias("last_day")).agg(F.count("*").alias("orders"))


@query("idn1_tax_ids", "SELECT s_suppkey, CASE s_suppkey % 6 WHEN 4 THEN NULL WHEN 5 THEN NULL ELSE lpad(CAST(s_suppkey AS VARCHAR), 9, '0') END AS tax_id, CASE s_suppkey % 6 WHEN 2 THEN NULL WHEN 4 THEN NULL WHEN 5 THEN NULL ELSE lpad(CAST(s_suppkey AS VARCHAR), 9, '0') END AS strict_tax_id FROM supplier")
def tax_ids(spark, sf_dir):
    s, n = table(spark, sf_dir, "supplier"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0")
    k = F.col("s_suppkey") % 6
    written = F.when(k == 0, n).when(k == 1, F.concat(F.lit("EL "), n)).when(k == 2, F.concat(F.lit("VAT EL"), n, F.lit(" (no. 2)"))).when(k == 3, F.concat(F.lit("ΑΦΜ: "), n)).when(k == 4, F.concat(n, F.lit("7"))).otherwise("EL")
    return s.select("s_suppkey", ids.normalize_tax_id(written).alias("tax_id"), ids.normalize_tax_id(written, False).alias("strict_tax_id"))


@query("idn3_stable_ids", f"WITH {O} SELECT id, 'contract:' || substr(sha1(printf('%.2f', amount) || '|' || strftime(issue_date, '%Y-%m') || '|' || supplier_key), 1, 12) AS contract_id, 'https://diavgeia.gov.gr/opendata/decisions/O-' || id AS url FROM o")
def stable_ids(spark, sf_dir):
    o = orders(spark, sf_dir)
    return o.select("id", ids.contract_id(F.col("amount"), F.col("issue_date"), F.col("supplier_key")).alias("contract_id"), ids.detail_url(F.col("ada")).alias("url"))


@query("idn5_referenced_adas", f"WITH {D} SELECT ada, CASE WHEN contains(subject, 'ΑΒΓΔ') THEN 'ΑΒΓΔ-123,ΑΒΓΔ-456' ELSE '' END AS refs FROM d")
def referenced(spark, sf_dir):
    d = decisions(spark, sf_dir)
    return d.select("ada", F.array_join(ids.referenced_adas(F.col("subject"), F.col("subject")), ",").alias("refs"))


@query("cls2_stage", f"WITH {D} SELECT CASE WHEN contains(subject, 'ανάκληση') THEN 'cancellation' ELSE 'other' END AS procurement_stage, count(*) AS decisions FROM d GROUP BY 1")
def stages(spark, sf_dir):
    from ..operators.summary import stage_breakdown

    return stage_breakdown(decisions(spark, sf_dir).withColumn("procurement_stage", C.procurement_stage(F.col("subject"))))


@query("cls1_type_labels", f"WITH {D} SELECT decision_type, count(*) AS decisions FROM d GROUP BY 1")
def type_labels(spark, sf_dir):
    return decisions(spark, sf_dir).groupBy(C.decision_type(F.col("decision_type_raw")).alias("decision_type")).agg(F.count("*").alias("decisions"))


ROLE = "CASE decision_type_raw WHEN 'Δ.1' THEN 'assignment' WHEN 'Δ.2.2' THEN 'award' WHEN 'Β.1.3' THEN 'payment_order' WHEN 'Β.2.1' THEN 'payment' ELSE 'contract' END"
WORDS = "CASE WHEN contains(subject, 'invoice') THEN 'invoice' WHEN contains(subject, 'ανάθεση') THEN 'assignment' END"


@query("cls3_lifecycle_roles", f"WITH {D} SELECT {ROLE} AS by_code, {WORDS} AS by_words, count(*) AS decisions FROM d GROUP BY ALL")
def roles(spark, sf_dir):
    none = F.lit(None).cast("string")
    return decisions(spark, sf_dir).groupBy(C.lifecycle_role(F.col("decision_type_raw"), F.col("subject"), none).alias("by_code"), C.lifecycle_role(none, F.col("subject"), none).alias("by_words")).agg(F.count("*").alias("decisions"))


@query("cls4_supplier_types", "SELECT s_suppkey, CASE s_suppkey % 8 WHEN 0 THEN 'tax_authority' WHEN 1 THEN 'social_security' WHEN 2 THEN 'public_authority' WHEN 3 THEN 'school_committee' WHEN 4 THEN 'municipality_internal' WHEN 5 THEN 'public_authority' WHEN 6 THEN 'unknown' ELSE 'vendor' END AS supplier_type FROM supplier")
def supplier_types(spark, sf_dir):
    k = F.col("s_suppkey") % 8
    given = ("Δ.Ο.Υ. {}", "ΕΦΚΑ {}", "Υπουργείο {}", "Σχολική Επιτροπή {}", "Δήμου Λαμιέων {}", "Δήμου {}")
    name = F.coalesce(*[F.when(k == i, F.concat(F.lit(g.split("{")[0].replace("Δ.Ο.Υ.", "ΔΟΥ")), "s_name")) for i, g in enumerate(given)], F.when(k == 7, F.col("s_name")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", C.supplier_type(name, F.lit(None).cast("string")).alias("supplier_type"))


@query("cls5_categories", f"""WITH {D} SELECT CASE WHEN contains(subject, 'ανάθεση') OR contains(subject, 'προμήθεια') THEN 'Procurement / contract' WHEN contains(subject, 'payment') THEN 'Finance / payment' ELSE 'Other' END AS category, count(*) AS decisions FROM d GROUP BY 1""")
def categories(spark, sf_dir):
    return decisions(spark, sf_dir).groupBy(C.category(F.lit(None).cast("string"), F.col("subject")).alias("category")).agg(F.count("*").alias("decisions"))


@query("agg33_themes", f"""WITH {D} SELECT CASE WHEN contains(subject, 'προϋπολογισμός') THEN 'digital / IT / software' WHEN contains(subject, 'έργου') THEN 'construction / maintenance' ELSE 'other' END AS theme, count(*) AS decisions FROM d GROUP BY 1""")
def themes(spark, sf_dir):
    from ..operators.summary import theme_summary

    return theme_summary(decisions(spark, sf_dir), C.theme(F.col("subject")))


@query("cls7_tags", f"WITH {D} SELECT contains(subject, 'invoice') AS recurring, count(*) AS decisions FROM d GROUP BY 1")
def tags(spark, sf_dir):
    subject = F.replace(F.col("subject"), F.lit("invoice"), F.lit("αποκομιδή απορριμμάτων"))
    return decisions(spark, sf_dir).groupBy((F.size(C.procurement_tags(subject)) > 0).alias("recurring")).agg(F.count("*").alias("decisions"))


@query("cls8_revocations", f"WITH {D} SELECT ada, contains(subject, 'ανάκληση') AS is_revocation, CASE WHEN contains(subject, 'ανάκληση') THEN 'ΑΒΓΔ-123' END AS revokes_ada FROM d")
def revocation_fields(spark, sf_dir):
    d, none = decisions(spark, sf_dir), F.lit(None).cast("string")
    yes = C.is_revocation(none, F.col("subject"), none)
    return d.select("ada", yes.alias("is_revocation"), C.revoked_ada(F.col("ada"), yes, F.col("subject")).alias("revokes_ada"))


@query("cls11_stage_authority", f"WITH {O} SELECT id, CASE decision_type WHEN 'ΚΑΤΑΚΥΡΩΣΗ' THEN 10 WHEN 'ΣΥΜΒΑΣΗ' THEN 9 WHEN 'ΑΝΑΛΗΨΗ ΥΠΟΧΡΕΩΣΗΣ' THEN 6 WHEN 'ΕΓΚΡΙΣΗ ΔΑΠΑΝΗΣ' THEN 4 ELSE 8 END AS authority FROM o")
def authority(spark, sf_dir):
    return orders(spark, sf_dir).select("id", C.stage_authority(F.col("decision_type")).alias("authority"))


@query("flt3_lifecycle_decisions", f"WITH {D} SELECT count(*) AS decisions, count(*) FILTER (decision_type_raw <> 'Β.2.1' OR supplier_tax_id IS NOT NULL OR contains(subject, 'υπηρεσίας') OR contains(subject, 'ανάθεση') OR contains(subject, 'προμήθεια')) AS bought FROM d")
def lifecycle_decisions(spark, sf_dir):
    yes = C.is_lifecycle_decision(F.col("decision_type_raw"), F.col("subject"), F.lit(None).cast("string"), F.col("supplier_tax_id"))
    return decisions(spark, sf_dir).agg(F.count("*").alias("decisions"), F.count_if(yes).alias("bought"))


@query("flt6_emergencies", f"WITH {D} SELECT ada, amount FROM d WHERE contains(subject, 'διαπραγμάτευση')")
def emergencies(spark, sf_dir):
    return decisions(spark, sf_dir).filter(C.is_emergency(F.col("subject"))).select("ada", "amount")


@query("flt7_detail_scores", f"""WITH {D}, s AS (SELECT ada, CASE WHEN contains(subject, 'ανάκληση') THEN -10 ELSE CASE WHEN decision_type_raw IN ('Δ.1', 'Δ.2.2', 'Δ.2.3', 'Β.2.1', 'Β.1.3') THEN 3 ELSE 0 END
  + CASE WHEN contains(subject, 'προμήθεια') THEN 3 WHEN contains(subject, 'ανάθεση') THEN 2 WHEN contains(subject, 'έργου') THEN 1 ELSE 0 END - CASE WHEN supplier_tax_id IS NOT NULL THEN 2 ELSE 0 END END AS score FROM d) SELECT score, count(*) AS decisions FROM s WHERE score >= 2 GROUP BY 1""")
def detail_scores(spark, sf_dir):
    score = C.detail_score(F.col("decision_type_raw"), F.col("subject"), F.col("amount").isNotNull(), F.col("supplier_tax_id").isNotNull())
    return decisions(spark, sf_dir).withColumn("score", score).filter("score >= 2").groupBy("score").agg(F.count("*").alias("decisions"))


@query("flt8_should_hydrate", f"WITH {D} SELECT count(*) FILTER (month % 2 = 0 OR contains(subject, 'ανάθεση') OR contains(subject, 'προμήθεια') OR contains(subject, 'payment')) AS wanted FROM d")
def should_hydrate(spark, sf_dir):
    raw = F.when(F.col("month") % 2 == 0, F.col("decision_type_raw")).otherwise("Γ.2")
    return decisions(spark, sf_dir).agg(F.count_if(C.should_hydrate(raw, F.col("subject"))).alias("wanted"))


@query("flt9_types", f"WITH {D} SELECT ada, decision_type_raw FROM d WHERE decision_type_raw IN ('Δ.1', 'Β.2.1')")
def types(spark, sf_dir):
    return decisions(spark, sf_dir).filter(F.col("decision_type_raw").isin("Δ.1", "Β.2.1")).select("ada", "decision_type_raw")


@query("join8_token_overlap", f"""WITH t AS (SELECT conv_id, turn, list_distinct(list_filter(string_split({canonical('text')}, ' '), lambda x: length(x) >= 4)) AS t FROM conversations)
SELECT a.conv_id, a.turn, round(CASE WHEN len(a.t) > 0 AND len(b.t) > 0 THEN len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) ELSE 0 END, 6) AS overlap FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def overlaps(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.text_tokens(F.col("text")).alias("t"))
    b = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("t").alias("u"))
    return t.join(b, ["conv_id", "turn"]).select("conv_id", "turn", F.round(text.token_overlap(F.col("t"), F.col("u")), 6).alias("overlap"))

"""Predicates and classes of decisions as column expressions."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V
from .ids import normalize_tax_id, referenced_adas
from .text import bound, canonical_supplier_name, canonical_text, contains_any, first_containing, normalize_text, starts_word

MOST_AMOUNT = 10_000_000


def joined(*parts: Column) -> Column:
    """The canonical text of all parts that are there."""
    return canonical_text(F.concat_ws(" ", *parts))


def decision_type(raw: Column, label: Column | None = None) -> Column:
    """The label if there is one, else the code's label, else the code."""
    codes = F.create_map(*[F.lit(x) for pair in V.DECISION_TYPES.items() for x in pair])
    known = F.coalesce(codes[normalize_text(raw)], normalize_text(raw))
    return known if label is None else F.coalesce(normalize_text(label), known)


def procurement_stage(text: Column) -> Column:
    return first_containing(canonical_text(text), V.STAGE_PHRASES, "other")


def is_procurement(decision_type_: Column, subject: Column, amount: Column, supplier_key: Column) -> Column:
    """Not ruled out by a phrase or an amount above 10 million, and with a supplier, an amount or a word of procurement."""
    # No higher-order function, so that all of it stays in generated code; the last test is made only without a supplier or an amount.
    text = joined(decision_type_, subject)
    out = F.coalesce(amount > MOST_AMOUNT, F.lit(False)) | starts_word(text, (*V.NOT_PROCUREMENT, *V.PERSONNEL_PHRASES))
    return ~out & (supplier_key.isNotNull() | amount.isNotNull() | contains_any(text, V.PROCUREMENT_WORDS))


def lifecycle_role(raw_type: Column, title: Column, type_label: Column) -> Column:
    """By the decision's code, else by words of its title and type; null if neither tells."""
    codes = F.create_map(*[F.lit(x) for pair in V.LIFECYCLE_ROLES.items() for x in pair])
    return F.coalesce(codes[raw_type], first_containing(joined(title, type_label), V.ROLE_WORDS, None))


def is_recurring(*parts: Column) -> Column:
    return contains_any(joined(*parts), V.RECURRING_WORDS)


def procurement_tags(*parts: Column) -> Column:
    return F.when(is_recurring(*parts), F.array(F.lit("recurring service"))).otherwise(F.array().cast("array<string>"))


def is_lifecycle_decision(raw_type: Column, title: Column, type_label: Column, supplier_key: Column) -> Column:
    """Whether a decision belongs to a purchase's life: by code, role, a payment for a supplier or service, or words."""
    text, role = joined(title, type_label, raw_type), lifecycle_role(raw_type, title, type_label)
    paid = (role == "payment") & (supplier_key.isNotNull() | contains_any(text, V.SERVICE_WORDS))
    bought = role.isin("assignment", "award", "contract", "notice", "invoice", "commitment", "payment_order")
    no = F.lit(False)
    return F.coalesce(raw_type.startswith("Δ."), no) | F.coalesce(bought, no) | F.coalesce(paid, no) | contains_any(text, (*V.RECURRING_WORDS, *V.PROCUREMENT_WORDS))


def subject_contains(subject: Column, words) -> Column:
    """Whether a subject contains any of the words, whatever their case; null does not."""
    return F.coalesce(subject.rlike("(?iu)" + "|".join(words)), F.lit(False))


def is_emergency(subject: Column) -> Column:
    return subject_contains(subject, V.EMERGENCY_STEMS) & ~subject_contains(subject, V.PROCEDURE_PHRASES)


def detail_score(raw_type: Column, subject: Column, has_amount: Column, has_supplier: Column) -> Column:
    """How much a decision is worth a look at its record: -10 for noise; 3 for its type, 1 for each of up to three words, 2 less if complete."""
    def score(text: Column) -> Column:
        hits = functools.reduce(lambda a, b: a + b, [F.contains(text, F.lit(w)).cast("int") for w in V.DETAIL_WORDS])
        points = F.when(raw_type.isin(*V.DETAIL_TYPES), 3).otherwise(0) + F.least(hits, F.lit(3)) - F.when(has_amount & has_supplier, 2).otherwise(0)
        return F.when(starts_word(text, V.DETAIL_NOISE), -10).otherwise(points)

    return bound(joined(raw_type, subject), score)


def should_hydrate(raw_type: Column, subject: Column) -> Column:
    """Whether a decision's type or a financial word of its subject asks for its record."""
    typed = functools.reduce(lambda a, b: a | b, [raw_type.startswith(p) for p in V.DETAIL_PREFIXES])
    return F.coalesce(typed, F.lit(False)) | contains_any(F.lower(F.coalesce(subject, F.lit(""))), V.FINANCIAL_WORDS)


def missing_fields(*names: str) -> Column:
    """The required fields that are null or empty."""
    return F.array_compact(F.array(*[F.when(F.col(n).isNull() | (F.col(n).cast("string") == ""), F.lit(n)) for n in names]))


def supplier_type(name: Column, tax_id: Column) -> Column:
    """Kind of a counterparty by the words of its name."""
    return supplier_type_of(canonical_supplier_name(name), tax_id)


def supplier_type_of(canonical: Column, tax_id: Column) -> Column:
    """As supplier_type, of a name that is canonical already."""
    return bound(canonical_text(canonical), lambda key: _kind(key, tax_id))


def _kind(key: Column, tax_id: Column) -> Column:
    padded, whole = F.concat(F.lit(" "), key, F.lit(" ")), F.replace(key, F.lit(" "), F.lit(""))
    has = lambda *ws: functools.reduce(lambda a, b: a & b, [F.contains(padded, F.lit(f" {w} ")) for w in ws])
    any_of = lambda ws: contains_any(padded, [f" {w} " for w in ws])
    own = has("δημος", "λαμιεων") | has("δημου", "λαμιεων") | whole.isin("δευαλ", "δημοτικηεπιχειρησηυδρευσηςαποχετευσηςλαμιας")
    tax = any_of(V.TAX_WORDS) | contains_any(whole, ("δου", "ααδε")) | F.contains(key, F.lit("δημοσια οικονομικη υπηρεσια"))
    empty = F.coalesce(key == "", F.lit(True))
    return (
        F.when(empty & normalize_tax_id(tax_id).isNull(), "unknown")
        .when(empty, "vendor")
        .when(has("σχολικη", "επιτροπη"), "school_committee")
        .when(own, "municipality_internal")
        .when(tax, "tax_authority")
        .when(any_of(V.INSURANCE_WORDS), "social_security")
        .when(any_of(V.AUTHORITY_WORDS) | has("δημος") | has("δημου"), "public_authority")
        .otherwise("vendor")
    )


def category(type_label: Column, title: Column) -> Column:
    """The decision's type if known, else by words of its title."""
    t = F.lower(F.coalesce(title, F.lit("")))
    return F.coalesce(normalize_text(type_label), *[F.when(t.rlike(p), F.lit(n)) for n, p in V.CATEGORIES], F.lit("Other"))


def theme(*parts: Column) -> Column:
    return first_containing(joined(*parts), V.THEMES, "other")


def is_revocation(raw_type: Column, title: Column, type_label: Column) -> Column:
    # Only codes tell of a role of revocation; the words of roles do not.
    codes = [code for code, role in V.LIFECYCLE_ROLES.items() if role in ("procurement_revocation", "payment_correction_or_revocation")]
    return F.coalesce(raw_type.isin(*codes), F.lit(False)) | contains_any(joined(title, type_label, raw_type), V.REVOCATION_WORDS)


def revoked_ada(ada: Column, revokes: Column, *texts: Column) -> Column:
    """The first other decision that a revocation names."""
    return F.when(revokes, F.get(F.array_remove(referenced_adas(*texts), F.upper(F.coalesce(ada, F.lit("")))), F.lit(0)))


def confidence(complete: Column, capped: Column, hydrated: Column, amounts: Column, suppliers: Column) -> Column:
    """Rating of a month's coverage; shares in per cent."""
    return F.when(capped | ~complete | (hydrated < 20), "red").when((hydrated < 70) | (amounts < 35) | (suppliers < 35), "yellow").otherwise("green")


def stage_authority(type_label: Column) -> Column:
    """The greatest authority of the labels in a decision's type; 0 without one."""
    t = F.coalesce(type_label, F.lit(""))
    return F.greatest(F.lit(0), *[F.when(F.contains(t, F.lit(k)), F.lit(v)).otherwise(0) for k, v in V.STAGE_AUTHORITY.items()])


def richness(names: list[str], lists: list[str], enriched: Column | None = None) -> Column:
    """How much of a record is filled: (priority fields, list items, enriched), comparable."""
    filled = functools.reduce(lambda a, b: a + b, [(F.col(n).isNotNull() & (F.col(n).cast("string") != "")).cast("int") for n in names])
    items = functools.reduce(lambda a, b: a + b, [F.coalesce(F.size(n), F.lit(0)) for n in lists], F.lit(0))
    return F.struct(filled.alias("fields"), items.alias("items"), (enriched if enriched is not None else F.lit(False)).cast("int").alias("enriched"))

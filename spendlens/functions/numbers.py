"""Numbers as column expressions: amounts in European and plain notation, buckets and guarded ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V
from .text import canonical_text, contains_any, normalize_text

MOST_BUDGET = 10_000_000


def parse_amount(text: Column) -> Column:
    """`1.234,56`, `1234,5`, `1.234` (thousands) and `12.5` to a double, euro signs and blanks left out; null if none."""
    t = F.translate(F.trim(text), "€ ", "")
    t = (
        F.when(F.contains(t, F.lit(",")) & F.contains(t, F.lit(".")), F.translate(F.translate(t, ".", ""), ",", "."))
        .when(F.contains(t, F.lit(",")), F.translate(t, ",", "."))
        .when(t.rlike(r"^[+-]?\d{1,3}(\.\d{3})+$"), F.translate(t, ".", ""))
        .otherwise(t)
    )
    return t.try_cast("double")


def plain_amount(text: Column) -> Column:
    """A number or {"amount": number}; a comma counts as decimal point, and nothing else is done (`1.234,56` is null)."""
    value = F.coalesce(F.get_json_object(text, "$.amount"), text)
    return F.translate(value, ",", ".").try_cast("double")


#: Fixed value: what counts as a number in a subject.
BUDGET_NUMBER = r"(\d{1,3}(?:[.\s]\d{3})+(?:,\d{2})?|\d+,\d{2})"


def budget_in_subject(subject: Column) -> Column:
    """The largest amount of a subject with a mark of a budget, of those from 1 to 10 million; null if none."""
    text = F.coalesce(normalize_text(subject), F.lit(""))
    found = F.regexp_extract_all(text, F.lit(BUDGET_NUMBER), F.lit(1))
    amounts = F.filter(F.transform(found, parse_amount), lambda a: a.between(1, MOST_BUDGET))
    return F.when(contains_any(canonical_text(subject), V.BUDGET_MARKS), F.array_max(amounts))


#: Fixed value: an amount with a euro mark behind it.
EURO_IN_TEXT = r"(?iu)(?<!\d)(\d{1,3}(?:\.\d{3})*(?:,\d{2})|\d+(?:,\d{2})?)\s*(?:€|ευρώ|ευρω)"


def euro_amount(text: Column) -> Column:
    """The first amount of a free text with a euro mark behind it; null if none."""
    return parse_amount(F.nullif(F.regexp_extract(text, EURO_IN_TEXT, 1), F.lit("")))


def cents(amount: Column) -> Column:
    """An amount in whole cents, halves to the even one."""
    return F.rint(amount * 100).cast("long")


def amount_bucket(amount: Column) -> Column:
    """Whole cents as text, or `noamount`."""
    return F.coalesce(cents(amount).cast("string"), F.lit("noamount"))


def number_or(value: Column, otherwise: float | None = 0.0) -> Column:
    """A double; ``otherwise`` where it is null, unreadable or not a number."""
    return F.coalesce(F.nanvl(value.try_cast("double"), F.lit(None).cast("double")), F.lit(otherwise).cast("double"))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole; null where whole is 0."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def percent_change(now: Column, before: Column) -> Column:
    """Change in per cent; null where there was nothing."""
    return F.try_divide((now - before).cast("double") * 100, before.cast("double"))


def is_non_round(amount: Column) -> Column:
    """Whether an amount is no multiple of 100."""
    return amount % 100 != 0

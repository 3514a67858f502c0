"""Identifiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import canonical_supplier_name, canonical_text, supplier_name_normalized

#: Fixed value: where the public register shows a decision.
DETAIL_URL = "https://diavgeia.gov.gr/opendata/decisions/"


def normalize_tax_id(text: Column, embedded: bool = True) -> Column:
    """Nine digits, `EL` before them or not; EL and nine digits inside other text if ``embedded``; or the text's only run of digits, if of nine."""
    t = text.cast("string")
    compact = F.upper(F.regexp_replace(t, "[^0-9A-Za-z]", ""))
    found = [F.nullif(F.regexp_extract(compact, r"^(?:EL)?(\d{9})$", 1), F.lit(""))]
    if embedded:
        found.append(F.nullif(F.regexp_extract(compact, r"EL(\d{9})(?!\d)", 1), F.lit("")))
    found.append(F.nullif(F.regexp_extract(t, r"^\D*(\d{9})\D*$", 1), F.lit("")))
    return F.when(t.rlike(r"^\d{9}$"), t).otherwise(F.coalesce(*found))


def short_hash(text: Column) -> Column:
    return F.substring(F.sha1(F.encode(text, "UTF-8")), 1, 12)


def supplier_key(name: Column, tax_id: Column) -> Column:
    """`tax:` and the tax id, else `name:` and a hash of the normalised name, else null."""
    return F.coalesce(F.concat(F.lit("tax:"), normalize_tax_id(tax_id)), F.concat(F.lit("name:"), short_hash(supplier_name_normalized(name))))


def readable_supplier_key(name: Column, tax_id: Column) -> Column:
    """`tax:` and the tax id, else `name:` and the canonical name itself, else null."""
    named = F.nullif(canonical_text(canonical_supplier_name(name)), F.lit(""))
    return F.coalesce(F.concat(F.lit("tax:"), normalize_tax_id(tax_id)), F.concat(F.lit("name:"), named))


def hashed_id(prefix: str, *parts: Column) -> Column:
    """prefix and a hash of the parts that are not null, joined by bars."""
    return F.concat(F.lit(prefix), short_hash(F.concat_ws("|", *parts)))


def contract_id(amount: Column, issue_date: Column, key: Column) -> Column:
    """The id of a contract: of its amount to the cent, its month and its supplier."""
    return hashed_id("contract:", F.format_string("%.2f", amount), F.coalesce(F.substring(issue_date.cast("string"), 1, 7), F.lit("")), F.coalesce(key, F.lit("")))


def detail_url(ada: Column, known: Column | None = None) -> Column:
    """The known url, or that of the decision's record."""
    made = F.concat(F.lit(DETAIL_URL), F.replace(F.url_encode(ada), F.lit("+"), F.lit("%20")))
    return made if known is None else F.coalesce(F.nullif(known, F.lit("")), made)


def referenced_adas(*texts: Column) -> Column:
    """Decision ids named in texts, in order, each once."""
    text = F.translate(F.upper(F.concat_ws(" ", *texts)), "–", "-")
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<![0-9A-ZΑ-Ω])([0-9A-ZΑ-Ω]{4,}-[0-9A-ZΑ-Ω]{3,})(?![0-9A-ZΑ-Ω])"), F.lit(1)))

"""Text as column expressions: canonical form, labels, tokens and names."""

from __future__ import annotations

import functools
import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V


@functools.cache
def accents() -> tuple[str, str]:
    """Letters with accents and what is left of each without, over the Latin and Greek blocks."""
    blocks = (range(0xC0, 0x250), range(0x370, 0x400), range(0x1E00, 0x2000))
    found = []
    for c in (chr(p) for block in blocks for p in block):
        plain = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if len(plain) == 1 and plain != c:
            found.append((c, plain))
    return "".join(a for a, _ in found), "".join(b for _, b in found)


def plain(text: Column) -> Column:
    """Lower case without accents."""
    return F.regexp_replace(F.translate(F.lower(text), *accents()), r"\p{Mn}+", "")


def canonical_text(text: Column) -> Column:
    """Lower case, without accents, all but digits and Latin and Greek letters one blank; null is empty."""
    return F.trim(F.regexp_replace(plain(F.coalesce(text, F.lit(""))), "[^0-9a-zα-ω]+", " "))


def normalize_label(text: Column) -> Column:
    """Lower case, without accents, white space, underscores and hyphens."""
    return F.regexp_replace(plain(text), r"[\s_\-]+", "")


def normalize_text(text: Column) -> Column:
    """Trimmed text; null if empty."""
    return F.nullif(F.regexp_replace(text, r"^\s+|\s+$", ""), F.lit(""))


def compact_text(text: Column, words: int = 12) -> Column:
    """The first canonical words joined by hyphens, or `untitled`."""
    return compact(canonical_text(text), words)


def compact(canonical: Column | str, words: int = 12) -> Column:
    """As compact_text, of a text that is canonical already."""
    return F.coalesce(F.nullif(F.array_join(F.slice(F.split(canonical, " "), 1, words), "-"), F.lit("")), F.lit("untitled"))


#: Letters of a canonical word that counts as a token.
TOKEN = 4


def text_tokens(text: Column, least: int = TOKEN) -> Column:
    """The set of canonical words of so many letters."""
    return F.array_distinct(F.filter(F.split(canonical_text(text), " "), lambda t: F.length(t) >= least))


def token_overlap(left: Column, right: Column) -> Column:
    """The Jaccard similarity of two token arrays; 0 if one is empty."""
    both = F.size(F.array_intersect(left, right))
    return F.when((F.size(left) > 0) & (F.size(right) > 0), both / F.size(F.array_union(left, right))).otherwise(F.lit(0.0))


def supplier_name_normalized(name: Column) -> Column:
    """Canonical text in upper case; null if empty."""
    return F.nullif(F.upper(canonical_text(name)), F.lit(""))


def canonical_supplier_name(name: Column, aliases: dict[str, str] | None = None) -> Column:
    """Upper-case canonical name without legal forms and `and`; of nothing but those, the name as it is. aliases: canonical name to name."""
    return bound(canonical_text(name), lambda text: _without_forms(text, name, aliases or {}))


def _without_forms(text: Column, name: Column, aliases: dict[str, str]) -> Column:
    bare = text
    forms = [r"\s*".join(f.split()) for f in V.LEGAL_LETTERS] + [r"\s+".join(f.split()) for f in V.LEGAL_WORDS] + ["και"]
    for form in forms:
        bare = F.regexp_replace(bare, rf"(?<![0-9a-zα-ω]){form}(?![0-9a-zα-ω])", " ")
    # A name without any of them is asked once, and stays as it is.
    bare = F.when(text.rlike(rf"(?<![0-9a-zα-ω])(?:{'|'.join(forms)})(?![0-9a-zα-ω])"), F.trim(F.regexp_replace(bare, r"\s+", " "))).otherwise(text)
    found = F.when(text == "", None).when(bare != "", F.upper(bare)).otherwise(F.upper(F.trim(name)))
    for known, name_ in aliases.items():
        found = F.when(text == known, F.lit(name_)).otherwise(found)
    return found


def clean_person_name(name: Column) -> Column:
    """`SURNAME,,FIRST` as words with single blanks; null if empty."""
    parts = F.filter(F.transform(F.split(name, ","), lambda p: F.trim(p)), lambda p: p != "")
    return F.nullif(F.array_join(parts, " "), F.lit(""))


def listing_text(text: Column, length: int) -> Column:
    """White space collapsed, and so many characters of it."""
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, length)


def contains_any(text: Column, words) -> Column:
    """Whether a text contains any of the words; one pattern, so that the text is worked out once."""
    return text.rlike(any_word(tuple(words)))


@functools.cache
def any_word(words: tuple[str, ...]) -> str:
    """The pattern of any of the words, beginnings that they share said once: at a letter that begins none, nothing else is tried."""
    letters: dict = {}
    for word in words:
        at = letters
        for c in word:
            at = at.setdefault(c, {})
        at[""] = {}

    def pattern(at: dict) -> str:
        if "" in at:  # what goes on from a whole word contains it anyway
            return ""
        found = [re.escape(c) + pattern(after) for c, after in at.items()]
        return found[0] if len(found) == 1 else f"(?:{'|'.join(found)})"

    return pattern(letters)


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def first_containing(text: Column, ladder, otherwise: str | None) -> Column:
    """The name of the first (name, words) of which the text contains a word."""
    return bound(text, lambda t: F.coalesce(*[F.when(contains_any(t, words), F.lit(name)) for name, words in ladder], F.lit(otherwise)))


def starts_word(text: Column, phrases) -> Column:
    """Whether any phrase stands in a canonical text at the beginning of a word."""
    return contains_any(F.concat(F.lit(" "), text, F.lit(" ")), [f" {p}" for p in phrases])

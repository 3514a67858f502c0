"""Searching records of changing shape inside their row: JSON text flattened to an array of its values, candidates ranked in the order of the document.

Nothing here joins or shuffles: a record's values (``record_values``, one pass over its text) are an array column, however deep they
nest, and a search is an expression over it: a filter for what can count, by bits and labels, then the order of what is left.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V
from .ids import normalize_tax_id
from .numbers import euro_amount, parse_amount, plain_amount
from .record_values import AMOUNT, CLOSED, NAME, NAME_LABELS, SUPPLIER, TAX, UNTRUSTED, named_text, sought, values  # noqa: F401  part of this module's interface
from .text import bound, clean_person_name, contains_any, normalize_text

EXTRA = "extraFieldValues"
#: Steps of the order inside an object: keys asked for, labelled values, extra fields, keys with a label's word, nested values.
KEYS, LABELLED, EXTRAS, WORDS, NESTED = 0, 1_000, 500_000, 1_000_000, 2_000_000


def first_present(record: Column, keys) -> Column:
    """The first of some keys of a map<string,string> that is neither null nor empty."""
    there = lambda v: F.when(~v.isin("", "[]"), v)
    return F.coalesce(*[there(record[k]) for k in keys])


def as_map(text: Column) -> Column:
    return F.from_json(text, "map<string,string>")


def as_list(text: Column) -> Column:
    return F.from_json(text, "array<string>")


def _is_scalar(value: Column) -> Column:
    return ~value.rlike(r"^[\[{]")


def named_first(record: Column, found: Column, keys) -> Column:
    """struct<text>: the text of the first of some keys of a record that is neither null nor empty, as ``named_text`` has it; null if there is none.

    record: the record as a map; found: its values.
    """
    own = F.map_from_entries(F.transform(F.filter(found, lambda x: (F.size(x["steps"]) == 1) & x["key"].isNotNull()), lambda x: F.struct(x["key"], x["named"])))
    return bound(own, lambda n: F.coalesce(*[F.when(~record[k].isin("", "[]"), F.struct(n[k].alias("text"))) for k in keys]))


def _has(bits: Column, word: int) -> Column:
    return bits.bitwiseAND(F.lit(word)) != 0


def _says(x: Column, words, but: tuple[str, ...] = ()) -> Column:
    """Whether a label beside the values of x contains one of the words (and none of ``but``)."""
    return F.exists(x["labels"], lambda t: contains_any(t, words) & ~contains_any(t, but) if but else contains_any(t, words))


def _first_of(found: Column) -> Column:
    return F.get(F.array_compact(found), F.lit(0))


def _first(hits: Column, name: str) -> Column:
    """``name`` of the hit with the least order, of those that have it."""
    return F.array_min(F.filter(F.transform(hits, lambda h: F.struct(h["o"].alias("o"), h[name].alias(name))), lambda h: h[name].isNotNull()))[name]


def _hits(found: Column, *kinds) -> Column:
    """What each of ``kinds`` makes of each value, as one array."""
    return F.flatten(F.transform(found, lambda x: F.array(*[kind(x) for kind in kinds])))


def _places(steps: Column, more: int = 0) -> Column:
    return F.transform(steps, lambda s: s["pos"] + more)


def _last(steps: Column) -> Column:
    return F.get(steps, F.size(steps) - 1)["pos"]


def _around(steps: Column) -> Column:
    return F.slice(steps, 1, F.greatest(F.lit(0), F.size(steps) - 1))


def _pair_amount(x: Column) -> Column:
    return _first_of(F.transform(x["vals"], lambda v: F.when(_is_scalar(v), parse_amount(v))))


def amounts(found: Column) -> Column:
    """struct<amount, path>: the first trusted amount of a record's values in document order; null if none.

    Trusted are values of amount keys and labelled pairs whose label says so. Nothing below subjects, urls, signers and units is trusted.
    """
    keyed_so = lambda x: _has(x["says"], AMOUNT) | F.coalesce(x["key"].isin(*V.AMOUNT_KEYS), F.lit(False))
    trusted = F.filter(found, lambda x: ~_has(x["above"], UNTRUSTED) & (keyed_so(x) | _has(x["pair"], AMOUNT)))
    hit = lambda order, amount, path: F.struct(order.alias("o"), F.when(amount.isNotNull(), F.struct(amount.alias("amount"), path.alias("path"))).alias("a"))

    def keyed(x: Column) -> Column:
        return hit(_places(x["steps"], 1), F.when(keyed_so(x) & _is_scalar(x["value"]), parse_amount(x["value"])), x["path"])

    def labelled(x: Column) -> Column:
        path = F.concat(F.when(x["path"] != "", F.concat(x["path"], F.lit("."))).otherwise(""), F.lit(f"{EXTRA}["), F.coalesce(x["said"], F.lit("amount")), F.lit("]"))
        return hit(F.concat(_places(x["steps"], 1), F.array(F.lit(0))), F.when(_has(x["pair"], AMOUNT), _pair_amount(x)), path)

    return _first(_hits(trusted, keyed, labelled), "a")


def any_amounts(found: Column) -> Column:
    """The amount as linked records look for it; null if none.

    In each object its extra fields come first, then keys that say amount, a labelled pair, a euro mark in the subject, and
    then what is nested.
    """
    says = lambda x: _has(x["says"], AMOUNT) | F.coalesce(x["key"].isin(*V.AMOUNT_KEYS), F.lit(False))
    around = lambda s: F.coalesce(s["key"].isin(*V.AMOUNT_KEYS) | contains_any(s["label"], V.AMOUNT_LABELS), F.lit(False))
    step = lambda s: F.when(s["key"] == EXTRA, F.lit(KEYS)).when(around(s), s["pos"] + LABELLED).otherwise(s["pos"] + NESTED)
    hit = lambda order, amount: F.struct(order.alias("o"), amount.alias("amount"))

    def keyed(x: Column) -> Column:
        subject_turn = F.coalesce(*[F.when(x["key"] == k, F.lit(WORDS + i)) for i, k in enumerate(V.SUBJECT_KEYS)])
        place = F.when(says(x), _last(x["steps"]) + LABELLED).otherwise(subject_turn)
        amount = F.when(says(x), parse_amount(x["value"])).when(subject_turn.isNotNull(), euro_amount(x["value"]))
        return hit(F.concat(F.transform(_around(x["steps"]), step), F.array(place)), F.when(_is_scalar(x["value"]), amount))

    def labelled(x: Column) -> Column:
        return hit(F.concat(F.transform(x["steps"], step), F.array(F.lit(WORDS - 1))), F.when(_has(x["pair"], AMOUNT), _pair_amount(x)))

    can = F.filter(found, lambda x: says(x) | _has(x["pair"], AMOUNT) | F.coalesce(x["key"].isin(*V.SUBJECT_KEYS), F.lit(False)))
    return _first(_hits(can, keyed, labelled), "amount")


def supplier_fields(found: Column) -> Column:
    """struct<supplier_name, supplier_tax_id>, each the first found: in an object its labelled pair, then its keys, then what is nested."""
    named_so = lambda x: F.coalesce(x["key"].isin(*V.SUPPLIER_NAME_KEYS), F.lit(False)) | (_has(x["says"], SUPPLIER) & ~_has(x["says"], TAX))

    def own(x: Column) -> Column:
        order = F.concat(_places(_around(x["steps"]), NESTED), F.array(_last(x["steps"])))
        return F.struct(order.alias("o"), F.when(named_so(x), x["named"]).alias("name"), F.when(_has(x["says"], TAX) & _is_scalar(x["value"]), normalize_tax_id(x["value"])).alias("tax"))

    def pair(x: Column) -> Column:
        name = F.when(_has(x["pair"], NAME), _first_of(x["val_names"]))
        tax = F.when(_has(x["pair"], TAX), _first_of(F.transform(x["vals"], lambda v: normalize_tax_id(v))))
        return F.struct(F.concat(_places(x["steps"], NESTED), F.array(F.lit(-1))).alias("o"), name.alias("name"), tax.alias("tax"))

    can = F.filter(found, lambda x: named_so(x) | _has(x["says"], TAX) | _has(x["pair"], NAME | TAX))
    return bound(_hits(can, own, pair), lambda hits: F.struct(_first(hits, "name").alias("supplier_name"), _first(hits, "tax").alias("supplier_tax_id")))


def supplier_fields_in_context(found: Column) -> Column:
    """struct<supplier_name, supplier_tax_id>: generic names and tax ids count only below a key that says supplier, and never below an issuer's."""
    ctx, tax_word = lambda x: _has(x["above"], SUPPLIER), lambda x: _has(x["says"], TAX)
    is_tax = lambda x: tax_word(x) & (ctx(x) | _has(x["says"], SUPPLIER))
    is_name = lambda x: F.coalesce(x["key"].isin(*V.SUPPLIER_NAME_KEYS), F.lit(False)) | (ctx(x) & F.coalesce(x["label"].isin(*NAME_LABELS), F.lit(False)))

    def hit(x: Column) -> Column:
        return F.struct(_places(x["steps"]).alias("o"), F.when(is_name(x) & ~is_tax(x), x["named"]).alias("name"), F.when(is_tax(x), normalize_tax_id(x["value"])).alias("tax"))

    can = F.filter(found, lambda x: ~_has(x["above"], CLOSED) & (is_tax(x) | is_name(x)))
    return bound(_hits(can, hit), lambda hits: F.struct(_first(hits, "name").alias("supplier_name"), _first(hits, "tax").alias("supplier_tax_id")))


def labelled_text(found: Column, keys, words) -> Column:
    """The first text of a record under one of the keys, else of a labelled pair, the extra fields, a key with one of the words, or nested."""
    step = lambda s: F.when(s["key"] == EXTRA, F.lit(EXTRAS)).otherwise(s["pos"] + NESTED)

    def own(x: Column) -> Column:
        turn = F.coalesce(*[F.when(x["key"] == k, F.lit(KEYS + i)) for i, k in enumerate(keys)])
        worded = contains_any(x["label"], words) & (x["key"] != EXTRA)
        place = F.coalesce(turn, F.when(worded, _last(x["steps"]) + WORDS))
        return F.struct(F.concat(F.transform(_around(x["steps"]), step), F.array(place)).alias("o"), F.when(place.isNotNull(), x["named"]).alias("text"))

    def pair(x: Column) -> Column:
        return F.struct(F.concat(F.transform(x["steps"], step), F.array(F.lit(LABELLED))).alias("o"), F.when(_says(x, words), _first_of(x["val_names"])).alias("text"))

    can = F.filter(found, lambda x: F.coalesce(x["key"].isin(*keys), F.lit(False)) | F.coalesce(contains_any(x["label"], words), F.lit(False)) | F.coalesce(_says(x, words), F.lit(False)))
    return _first(_hits(can, own, pair), "text")


def id_list(text: Column) -> Column:
    """Ids of a scalar, a list of scalars or a list of objects with uid or id."""
    one = lambda x: F.when(F.startswith(x, F.lit("{")), F.coalesce(as_map(x)["uid"], as_map(x)["id"])).otherwise(normalize_text(x))
    return F.array_compact(F.when(F.startswith(text, F.lit("[")), F.transform(as_list(text), one)).otherwise(F.array(one(text))))


def subject(record: Column) -> Column:
    """The first subject of a record, or of its extra fields."""
    extra = as_map(record[EXTRA])
    return F.coalesce(normalize_text(first_present(record, V.SUBJECT_KEYS)), normalize_text(first_present(extra, V.SUBJECT_KEYS)))


PERSON = "array<map<string,string>>"
SPONSOR = "array<struct<expenseAmount:string,sponsorAFMName:map<string,string>>>"


def typed_fields(detail: Column) -> dict[str, Column]:
    """amount, supplier_name and supplier_tax_id of a detail record by its decision type.

    Awards: awardAmount and the persons; expenditure and payment: the sum over the sponsors and the first of them; warrants:
    amountWithVAT; personal contracts: contractAmount and the persons; else the first amount key that has one.
    """
    record = as_map(detail)
    extra, kind = as_map(record[EXTRA]), record["decisionTypeId"]
    listed = lambda k, schema: F.from_json(F.when(F.startswith(extra[k], F.lit("{")), F.concat(F.lit("["), extra[k], F.lit("]"))).otherwise(extra[k]), schema)
    valid = lambda p: F.when(F.trim(F.coalesce(p["afm"], p["AFM"])).rlike(r"^\d{9}$"), F.trim(F.coalesce(p["afm"], p["AFM"])))
    person, sponsor = listed("person", PERSON), listed("sponsor", SPONSOR)
    sums = F.array_compact(F.transform(sponsor, lambda s: plain_amount(s["expenseAmount"])))
    total = F.when(F.size(sums) > 0, F.aggregate(sums, F.lit(0.0), lambda a, b: a + b))
    firsts = lambda xs: F.get(F.array_compact(xs), F.lit(0))
    persons, sponsors = kind.isin("Δ.1", "Δ.2.2", "Γ.3.4"), kind.isin("Β.2.1", "Β.2.2")
    typed = F.when(kind.isin("Δ.1", "Δ.2.2"), plain_amount(extra["awardAmount"])).when(sponsors, total).when(kind == "Β.1.3", plain_amount(extra["amountWithVAT"])).when(kind == "Γ.3.4", plain_amount(extra["contractAmount"]))
    return {
        "amount": F.coalesce(typed, *[plain_amount(extra[k]) for k in ("awardAmount", "contractAmount", "amountWithVAT", "estimatedAmount")]),
        "supplier_name": F.when(persons, firsts(F.transform(person, lambda p: clean_person_name(p["name"])))).when(sponsors, firsts(F.transform(sponsor, lambda s: clean_person_name(s["sponsorAFMName"]["name"])))),
        "supplier_tax_id": F.when(persons, firsts(F.transform(person, valid))).when(sponsors, firsts(F.transform(sponsor, lambda s: valid(s["sponsorAFMName"])))),
    }


REGISTRY = (
    "struct<afm:string,arGemi:string,coNameEl:string,status:struct<descr:string,isActive:boolean>,legalType:struct<id:string,descr:string>,incorporationDate:string,"
    "activities:array<struct<activity:struct<id:string,descr:string>,type:string,dtTo:string>>,capital:array<struct<capitalStock:string>>,"
    "persons:array<struct<firstName:string,lastName:string,dtTo:string>>,city:string,zipCode:string,street:string,streetNumber:string,prefecture:struct<descr:string>>"
)


def registry_fields(text: Column) -> dict[str, Column]:
    """A company-registry record as columns: the primary activity (one without an end first), the first capital, the members in office."""
    r = F.from_json(text, REGISTRY)
    primary = F.filter(r["activities"], lambda a: F.lower(a["type"]).isin("κύρια", "κυρια", "primary"))
    primary = F.concat(F.filter(primary, lambda a: a["dtTo"].isNull()), F.filter(primary, lambda a: a["dtTo"].isNotNull()))
    board = F.filter(r["persons"], lambda p: p["dtTo"].isNull())
    return {
        "supplier_tax_id": r["afm"], "registry_number": r["arGemi"], "legal_name": r["coNameEl"], "legal_form": r["legalType"]["descr"], "legal_form_id": r["legalType"]["id"],
        "status": r["status"]["descr"], "is_active": r["status"]["isActive"], "registration_date": F.substring(r["incorporationDate"], 1, 10).try_cast("date"),
        "share_capital": F.translate(F.get(r["capital"], F.lit(0))["capitalStock"], ",", ".").try_cast("double"),
        "address_street": r["street"], "address_number": r["streetNumber"], "address_city": r["city"], "address_postal_code": r["zipCode"], "address_prefecture": r["prefecture"]["descr"],
        "primary_activity_code": F.get(primary, F.lit(0))["activity"]["id"], "primary_activity_description": F.get(primary, F.lit(0))["activity"]["descr"],
        "board_members": F.array_join(F.transform(board, lambda p: F.concat_ws(" ", p["firstName"], p["lastName"])), "; "),
    }

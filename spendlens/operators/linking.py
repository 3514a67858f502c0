"""Linking decisions: stages of one contract, duplicates, lifecycle groups and revocations."""

from __future__ import annotations

import functools
import math
import sys

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vocabulary as V
from ..functions.classify import is_lifecycle_decision, lifecycle_role, stage_authority
from ..functions.dates import within_days
from ..functions.ids import contract_id, hashed_id
from ..functions.numbers import amount_bucket, cents
from ..functions.text import TOKEN, canonical_text, compact
from .components import connected_components
from .durable import stored
from .near_amounts import CLASS, class_links, classed
from .near_amounts import members as class_members
from .similar import links, sides, title_links, title_pairs

TOLERANCE, WINDOW_DAYS = 0.02, 180
DUPLICATE_SIMILARITY = 0.82


def tolerance_pairs(rows: DataFrame, tolerance: float = TOLERANCE, days: int = WINDOW_DAYS, strict_supplier: bool = False) -> DataFrame:
    """(src, dst): rows whose amounts differ by so small a share of the larger, dates by so few days, suppliers not at all.

    rows: id, amount, issue_date, supplier_tax_id. An unknown date or supplier matches any, unless ``strict_supplier``.
    Amounts fall into buckets on a logarithmic scale as wide as the tolerance, so matches are in the same or the next
    bucket; dated rows also fall into buckets of ``days``. Rows alike in amount, date and supplier match by themselves:
    each is linked to the first of them, and only the firsts are compared.
    """
    width = -math.log(1 - tolerance) * 1.000001
    # Rows alike in all that decides: a chain from each to the first stands for all their pairs.
    same = rows.filter("amount > 0").groupBy("amount", "issue_date", "supplier_tax_id").agg(F.min("id").alias("first"))
    node = stored(same.withColumns({"k": F.floor(F.log("amount") / width), "w": F.floor(F.unix_date("issue_date") / days)}))
    left = node.select(*[F.col(c).alias(f"l_{c}") for c in node.columns])
    right = node.select(*[F.col(c).alias(f"r_{c}") for c in node.columns]).withColumn("l_k", F.explode(F.array(F.col("r_k"), F.col("r_k") + 1)))
    near = F.abs(F.col("l_amount") - F.col("r_amount")) / F.greatest("l_amount", "r_amount") <= tolerance
    # A pair whose left bucket is the lower one is seen once; of equal buckets the smaller id is left.
    once = (F.col("l_k") > F.col("r_k")) | (F.col("l_first") < F.col("r_first"))
    match = near & once & within_days(F.col("l_issue_date"), F.col("r_issue_date"), days)
    # What both know is part of the join's key; rows that lack it meet by the amount alone.
    ways = (("not null", "not null"), ("null", None), ("not null", "null"))
    pairs = None
    for l_tax, r_tax in ways[:1] if strict_supplier else ways:
        for l_day, r_day in ways:
            a, b, key = left, right, ["l_k"]
            for column, l_is, r_is in (("supplier_tax_id", l_tax, r_tax), ("w", l_day, r_day)):
                a = a.filter(f"l_{column} is {l_is}")
                b = b if r_is is None else b.filter(f"r_{column} is {r_is}")
                if l_is == r_is:
                    key = [*key, f"l_{column}"]
                    meets = F.explode(F.array(*[F.col("r_w") + i for i in (-1, 0, 1)])) if column == "w" else F.col(f"r_{column}")
                    b = b.withColumn(f"l_{column}", meets)
            found = a.join(b, key).filter(match).select(F.col("l_first").alias("src"), F.col("r_first").alias("dst"))
            pairs = found if pairs is None else pairs.unionByName(found)
    return pairs


def same_rows(rows: DataFrame) -> DataFrame:
    """(src, dst) from every row to the first of those alike in amount, date and supplier."""
    rows = rows.filter("amount > 0")
    first = rows.groupBy(F.col("amount").alias("a"), F.col("issue_date").alias("d"), F.col("supplier_tax_id").alias("t")).agg(F.min("id").alias("dst"))
    alike = (F.col("amount") == F.col("a")) & F.col("issue_date").eqNullSafe(F.col("d")) & F.col("supplier_tax_id").eqNullSafe(F.col("t"))
    return rows.join(first, alike).select(F.col("id").alias("src"), "dst").filter("src <> dst")


def tolerance_classes(rows: DataFrame, **options) -> DataFrame:
    """(src, dst, kind): the pairs of ``tolerance_pairs``, src the smaller, and every row with the first of those alike in amount, date and supplier.

    kind `pair`: two that differ, each by its first; `member`: a row and its first. A row has the pairs of its first, and members match each
    other (with ``strict_supplier`` those of a known supplier). ids are unique.
    """
    pairs = tolerance_pairs(rows, **options)
    pairs = pairs.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), F.lit("pair").alias("kind"))
    return pairs.unionByName(same_rows(rows).withColumn("kind", F.lit("member")))


def contract_members(rows: DataFrame, tolerance: float = TOLERANCE, days: int = WINDOW_DAYS, strict_supplier: bool = False) -> DataFrame:
    """rows with component: the smallest id of those linked, its own where none is (rows without an amount always)."""
    there = F.coalesce(F.col("amount") > 0, F.lit(False))
    some = classed(rows.filter(there), tolerance, days, strict_supplier)
    # Rows of one class are linked, so only the classes need components: rows have theirs.
    classes, found = class_links(some, tolerance, days, strict_supplier)
    found = connected_components(found)
    known = stored(classes.join(found, "node", "left").select(*CLASS, F.coalesce("component", "node").alias("component")))
    return class_members(some, known).drop("undated", "k", "b", "x").unionByName(rows.filter(~there).withColumn("component", F.col("id")))


def contracts(members: DataFrame) -> DataFrame:
    """One row for each component: its most authoritative decision (earliest, then smallest id, of equals), stages and decisions.

    members: id, component, ada, amount, issue_date, decision_type, subject, supplier_key, supplier_tax_id, supplier_name.
    A row without an amount is a contract of its own with amount 0.
    """
    best = F.struct((-stage_authority(F.col("decision_type"))).alias("a"), F.col("issue_date").isNull().alias("n"), "issue_date", "id")
    pick = F.struct("ada", "amount", "issue_date", "decision_type", F.substring("subject", 1, 120).alias("subject"), "supplier_key", "supplier_tax_id", F.substring("supplier_name", 1, 80).alias("supplier_name"))
    g = members.groupBy("component").agg(
        F.min_by(pick, best).alias("b"), F.count("*").alias("stage_count"),
        F.array_sort(F.collect_set(F.coalesce("decision_type", F.lit("unknown")))).alias("stages_seen"),
        F.transform(F.array_sort(F.collect_list(F.struct("id", F.coalesce("ada", F.lit("")).alias("ada")))), lambda x: x["ada"]).alias("all_adas"),
    )
    g = g.select("component", "b.*", "stage_count", "stages_seen", "all_adas").withColumn("__has", F.coalesce(F.col("amount") > 0, F.lit(False)))
    key = F.coalesce("supplier_key", "supplier_tax_id", F.lit(""))
    named = F.when(F.col("__has"), contract_id(F.col("amount"), F.col("issue_date"), key)).otherwise(hashed_id("contract:", F.coalesce("ada", F.lit("no-ada"))))
    return g.withColumns({"contract_id": named, "amount": F.when(F.col("__has"), F.col("amount")).otherwise(0.0)}).drop("__has")


def lifecycle(members: DataFrame, made: DataFrame) -> DataFrame:
    """(ada, contract_id, decision_type, amount, issue_date) of every decision."""
    return members.join(made.select("component", "contract_id"), "component").select("ada", "contract_id", "decision_type", F.coalesce("amount", F.lit(0.0)).alias("amount"), "issue_date")


def savings(members: DataFrame, made: DataFrame) -> DataFrame:
    """Spend as the decisions add up, as the contracts do, and what the difference is of the first."""
    raw = members.agg(F.coalesce(F.sum("amount"), F.lit(0.0)).alias("raw_spend"))
    clean = made.agg(F.coalesce(F.sum("amount"), F.lit(0.0)).alias("clean_spend"), F.count("*").alias("contracts"), F.count_if(F.col("stage_count") > 1).alias("multi_stage"))
    one = raw.withColumn("__one", F.lit(1)).join(clean.withColumn("__one", F.lit(1)), "__one").drop("__one")  # one row each
    return one.withColumn("removed_pct", F.try_divide((F.col("raw_spend") - F.col("clean_spend")) * 100, "raw_spend"))


#: Pairs of titles that a worker remembers: where titles repeat, the same two meet again and again.
REMEMBERED = 1 << 18


@functools.lru_cache(maxsize=REMEMBERED)
def _ratio(a: str, b: str) -> float:
    """The ratio of two titles; remembered, since the same two meet on many days."""
    from difflib import SequenceMatcher

    return SequenceMatcher(None, a, b).ratio()


def _ratios(left: pd.Series, right: pd.Series) -> pd.Series:
    # Titles are interned, so that pairs that are remembered share them.
    return pd.Series([_ratio(sys.intern(a), sys.intern(b)) if a and b else 0.0 for a, b in zip(left, right, strict=True)], dtype=float)


def title_ratio(left: Column | str, right: Column | str) -> Column:
    """Ratcliff-Obershelp similarity of two canonical titles; 0 if one is empty. For pairs that meet by a key only."""
    return F.pandas_udf(_ratios, "double")(left, right)


#: Titles of so many letters are compared by the library itself, which leaves out their most frequent letters.
POPULAR = 200


def _longest(a: str, b: str) -> tuple[int, int, int]:
    """(i, j, k) of the longest block that both have, the first in ``a``, then the first in ``b``."""
    at, k, m = 0, 0, len(a)
    for i in range(m):
        if i + k >= m:
            break
        while i + k < m and a[i : i + k + 1] in b:
            at, k = i, k + 1
    return at, b.find(a[at : at + k]), k


def reaches(left: str | None, right: str | None, least: float | None) -> bool:
    """Whether the ratio of two titles is ``least`` or more, as ``title_ratio`` has it; False if a title or ``least`` is missing.

    The ratio counts the letters of matching blocks, longest first in each part that the blocks before left over. What is counted only grows,
    so it is enough once it reaches ``least``, and not any more once all that is left could not.
    """
    if not left or not right or least is None:
        return False
    if len(right) >= POPULAR:
        from difflib import SequenceMatcher

        return SequenceMatcher(None, left, right).ratio() >= least
    both, found, can, parts = len(left) + len(right), 0, min(len(left), len(right)), [(left, right)]
    while parts and 2.0 * (found + can) / both >= least:
        a, b = parts.pop()
        can -= min(len(a), len(b))
        i, j, k = _longest(a, b)
        if not k:
            continue
        found += k
        if 2.0 * found / both >= least:
            return True
        for part in ((a[:i], b[:j]), (a[i + k :], b[j + k :])):
            if part[0] and part[1]:
                can += min(len(part[0]), len(part[1]))
                parts.append(part)
    return 2.0 * found / both >= least


@functools.lru_cache(maxsize=REMEMBERED)
def _meets(left: str, right: str, least: float, overlap: float) -> bool:
    """Whether two canonical titles share so much of their words (as ``token_overlap`` of ``text_tokens``), or have a ratio of ``least``."""
    a, b = ({w for w in t.split(" ") if len(w) >= TOKEN} for t in (left, right))
    return bool(a and b and len(a & b) / len(a | b) >= overlap) or reaches(left, right, least)


def _reached(left: pd.Series, right: pd.Series, least: pd.Series, overlap: pd.Series) -> pd.Series:
    # A number that is missing differs from itself.
    asked = zip(left, right, least.astype(float).tolist(), overlap.astype(float).fillna(math.inf).tolist(), strict=True)
    return pd.Series([bool(x == x and a and b) and _meets(sys.intern(a), sys.intern(b), x, y) for a, b, x, y in asked], dtype=bool)


def title_reaches(left: Column | str, right: Column | str, least: Column, overlap: Column | None = None) -> Column:
    """Whether the ratio of two canonical titles is ``least`` or more, or ``overlap`` of their words are shared; where ``least`` is null nothing is worked out, and it is False."""
    asked = lambda title: F.when(least.isNotNull(), F.col(title) if isinstance(title, str) else title)
    return F.pandas_udf(_reached, "boolean")(asked(left), asked(right), least, F.lit(None).cast("double") if overlap is None else overlap)


def _told(d: DataFrame, texts: list[str], told: dict[str, Column]) -> DataFrame:
    """d with columns made of its ``texts`` columns, worked out once for each text that differs; where those are few they are broadcast, by the size of their file."""
    found = stored(d.select(*texts).distinct().withColumns(told)).withColumnsRenamed({c: f"__{c}" for c in texts})
    same = functools.reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in texts])
    return d.join(found, same).drop(*[f"__{c}" for c in texts])


def read_texts(d: DataFrame) -> DataFrame:
    """d with canon (canonical title), role and bought (whether it may belong to a purchase).

    d: title, decision_type, decision_type_raw, supplier_key and any others; read twice, so store it first if it is much work.
    """
    label = F.col("decision_type_raw"), F.col("title"), F.col("decision_type")
    told = {"canon": canonical_text(F.col("title")), "role": lifecycle_role(*label), "bought": is_lifecycle_decision(*label, F.when(F.col("supplied"), F.lit("")))}
    supplied = d.withColumn("supplied", F.col("supplier_key").isNotNull())
    return _told(supplied, ["title", "decision_type_raw", "decision_type", "supplied"], told).drop("supplied")


def _titled(d: DataFrame) -> DataFrame:
    """Decisions that may have duplicates, with cents and canonical title, and the first of those alike in date, cents and title. d: as of read_texts."""
    rows = d.filter("amount is not null and issue_date is not null and canon <> ''").select("id", "issue_date", cents(F.col("amount")).alias("cents"), F.col("canon").alias("title"))
    return rows.withColumn("first", F.min("id").over(Window.partitionBy("issue_date", "cents", "title")))


def _title_nodes(rows: DataFrame) -> DataFrame:
    return rows.filter("id = first").drop("first")


def _members(rows: DataFrame) -> DataFrame:
    return rows.filter("id <> first").select(F.col("id").alias("src"), F.col("first").alias("dst"))


def duplicate_pairs(d: DataFrame, similarity: float = DUPLICATE_SIMILARITY) -> DataFrame:
    """(src, dst, similarity, kind): the same date and cents and titles so alike. d: id, amount, issue_date, title.

    kind `pair`: two different titles, each by the first of its rows. kind `member`: a row and the first of those with its date, cents and
    title. A row has the pairs of its first. Titles that are empty are like none.
    """
    d = stored(d.filter("amount is not null and issue_date is not null").select("id", "amount", "issue_date", "title"))
    rows = stored(_titled(_told(d, ["title"], {"canon": canonical_text(F.col("title"))})))
    pairs = title_pairs(_title_nodes(rows), ["issue_date", "cents"], similarity, title_ratio).withColumn("kind", F.lit("pair"))
    return pairs.unionByName(_members(rows).withColumns({"similarity": F.lit(1.0), "kind": F.lit("member")}))


def _duplicate_links(d: DataFrame, similarity: float = DUPLICATE_SIMILARITY) -> DataFrame:
    """(src, dst) that join all that duplicate_pairs joins, without every pair of a large block. d: as of read_texts."""
    rows = stored(_titled(d))
    return title_links(_title_nodes(rows), ["issue_date", "cents"], similarity, title_ratio).unionByName(_members(rows))


def _purchases(d: DataFrame) -> DataFrame:
    """Decisions that may belong to a purchase, and the first of those alike in supplier, month, cents, role and title. d: as of read_texts.

    Without a supplier only equal cents can match, so those rows meet by cents too (block) and make no pairs of a whole month.
    """
    rows = d.filter(F.col("bought") & F.col("issue_date").isNotNull())
    rows = rows.select("id", F.coalesce("supplier_key", F.lit("unknown-supplier")).alias("supplier"), F.trunc("issue_date", "month").alias("month"), cents(F.col("amount")).alias("cents"), "role", F.col("canon").alias("title"))
    known = F.col("supplier") != "unknown-supplier"
    rows = rows.filter(known | F.col("cents").isNotNull()).withColumn("block", F.when(known, F.lit(0).cast("long")).otherwise(F.col("cents")))
    return rows.withColumn("first", F.min("id").over(Window.partitionBy("supplier", "month", "block", "cents", "role", "title")))


PURCHASE = ["supplier", "month", "block"]


def _purchase_match(pairs: DataFrame) -> DataFrame:
    """Pairs of one supplier and month that belong to one purchase: a month is shorter than the days that each rule allows."""
    no = F.lit(False)
    other_role = F.coalesce(F.col("l_role") != F.col("r_role"), no)
    same_cents = F.coalesce(F.col("l_cents") == F.col("r_cents"), no)
    known = F.col("supplier") != "unknown-supplier"
    # What needs no similarity is decided first; titles are compared for the remaining candidates only, and only as far as it takes to tell.
    enough = same_cents & other_role
    pairs = pairs.filter(same_cents | (known & other_role)).withColumn("enough", enough)
    # Of the rest one rule may apply: of those different in role the lower one.
    least, overlap = (F.when(~F.col("enough"), F.when(known & other_role, low).otherwise(high)) for low, high in ((0.25, 0.35), (0.12, 0.18)))
    return pairs.filter(F.col("enough") | title_reaches("l_title", "r_title", least, overlap))


#: Whether rows alike in all that decides are linked: they need an amount, and a title to be alike in.
_INNER = "cents is not null and title <> ''"


def lifecycle_pairs(d: DataFrame) -> DataFrame:
    """(src, dst, kind): decisions of one supplier and month that belong to one purchase.

    d: id, amount, issue_date, title, decision_type, decision_type_raw, supplier_key. Alike in cents, and in title (0.35), words (0.18) or
    different in role; or of a known supplier, different in role, and alike in title (0.25) or words (0.12). kind `pair`: two that differ, each by
    the first of the rows alike in supplier, month, cents, role and title; `member`: a row linked to its first; `alike`: a row with the
    pairs of its first that is not linked to it itself.
    """
    rows = stored(_purchases(read_texts(stored(d))))
    pairs = _purchase_match(sides(rows.filter("id = first").drop("first"), PURCHASE)).select(F.col("l_id").alias("src"), F.col("r_id").alias("dst"), F.lit("pair").alias("kind"))
    more = rows.filter("id <> first").select(F.col("id").alias("src"), F.col("first").alias("dst"), F.when(F.expr(_INNER), "member").otherwise("alike").alias("kind"))
    return pairs.unionByName(more)


def _lifecycle_links(d: DataFrame) -> DataFrame:
    """(src, dst) that join all that lifecycle_pairs joins, without every pair of a large block. d: as of read_texts."""
    rows = stored(_purchases(d))
    nodes = rows.filter("id = first").drop("first")
    # Of one amount, whatever differs in role is linked: with two roles or more, all that have one hang together.
    roles = nodes.filter("role is not null and cents is not null").groupBy(*PURCHASE, "cents").agg(F.min("id").alias("dst"), F.count_distinct("role").alias("n")).filter("n > 1")
    sure = nodes.filter("role is not null").join(roles, [*PURCHASE, "cents"]).filter("id <> dst").select(F.col("id").alias("src"), "dst")
    found = stored(links(nodes, PURCHASE, _purchase_match).unionByName(sure))
    member = rows.filter("id <> first")
    inner = member.filter(_INNER).select(F.col("id").alias("src"), F.col("first").alias("dst"))
    # Rows that are not linked to their first share what it is linked to, if there is anything.
    ends = found.select(F.col("src").alias("first"), "dst").unionByName(found.select(F.col("dst").alias("first"), F.col("src").alias("dst"))).groupBy("first").agg(F.min("dst").alias("dst"))
    shared = member.filter(f"not ({_INNER})").join(ends, "first").select(F.col("id").alias("src"), "dst")
    return found.unionByName(inner).unionByName(shared)


def grouped(d: DataFrame) -> DataFrame:
    """Decisions with group (smallest id linked), the group's size, whether it is a purchase, its canonical decision and id."""
    d = read_texts(d.drop("role"))
    found = connected_components(_duplicate_links(d).unionByName(_lifecycle_links(d)))
    g = d.join(found, d["id"] == found["node"], "left").drop("node").withColumn("group", F.coalesce("component", "id")).drop("component")
    turn = F.coalesce(*[F.when(F.col("role") == r, F.lit(i)) for i, r in enumerate(V.ROLE_ORDER)], F.lit(99))
    g = stored(g.withColumns({"turn": turn, "compact": compact("canon")}))
    # No window: what is known of a group is summed up before the shuffle, however many of the decisions it has.
    basis, order = F.struct("id", "ada", "issue_date", "amount", "compact", "supplier_key"), [F.coalesce(F.col("issue_date").cast("string"), F.lit("")), amount_bucket(F.col("amount")), "compact", "ada", "id"]
    told = g.groupBy(F.col("group").alias("__g")).agg(F.count("*").alias("group_size"), F.max("bought").alias("is_purchase"), F.min_by(basis, F.struct("turn", *order)).alias("__t"), F.min_by(basis, F.struct(*order)).alias("__o"))
    told = told.withColumn("__b", F.when(F.col("is_purchase"), F.col("__t")).otherwise(F.col("__o")))
    prefix = F.when(F.col("is_purchase"), "procurement-").otherwise("decision-")
    name = hashed_id("", F.col("__b.issue_date").cast("string"), amount_bucket(F.col("__b.amount")), F.col("__b.supplier_key"), F.col("__b.compact"))
    told = told.select("__g", "group_size", "is_purchase", F.concat(prefix, name).alias("canonical_id"), F.col("__b.ada").alias("canonical_ada"), F.col("__b.id").alias("__id"))
    return g.join(told, g["group"] == told["__g"]).withColumn("is_canonical", F.col("id") == F.col("__id")).drop("__g", "__id", "turn", "compact", "bought", "canon")


def group_summary(g: DataFrame) -> DataFrame:
    """Groups, purchases, purchases of several decisions, and decisions in groups."""
    return g.agg(F.count_distinct("group").alias("groups"), F.count_distinct(F.when(F.col("is_purchase"), F.col("canonical_id"))).alias("procurement_events"), F.count_distinct(F.when(F.col("is_purchase") & (F.col("group_size") > 1), F.col("group"))).alias("lifecycle_groups"), F.count_if(F.col("group_size") > 1).alias("grouped_decisions"))


def top_events(g: DataFrame, top: int = 20) -> DataFrame:
    """The largest purchases: their decision with the largest amount, roles, tags and decisions. g: as from grouped, with tags (array)."""
    e = g.filter("is_purchase and amount is not null and not is_revocation")
    largest = F.min_by(F.struct("ada", "amount", "issue_date", "title"), F.struct(-F.col("amount"), ~F.col("is_canonical"), "issue_date", "ada"))
    order = [F.desc("amount"), F.desc("issue_date"), "canonical_id"]
    best = e.groupBy("canonical_id").agg(largest.alias("p")).select("canonical_id", "p.*").orderBy(*order).limit(top)
    # Lists are gathered of the ``top`` purchases only.
    best = stored(best)
    of = e.select("canonical_id", "role", "tags", F.col("ada").alias("__a")).join(F.broadcast(best.select("canonical_id")), "canonical_id").groupBy("canonical_id").agg(
        F.array_sort(F.collect_set("role")).alias("lifecycle_roles"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags")))).alias("tags"),
        F.count("*").alias("decisions"), F.array_sort(F.collect_list("__a")).alias("related_adas"),
    )
    return best.join(of, "canonical_id").orderBy(*order).limit(top)


def exclusion_reasons(g: DataFrame, top: int = 20) -> DataFrame:
    """Decisions with exclusion_reason, why they are not among the largest purchases; null for those that are.

    g: as for top_events, each with is_lifecycle. In turn: no part of a purchase, no amount, a revocation, and a purchase beyond the top ones.
    """
    reason = F.when(~F.col("is_lifecycle"), "not_procurement_lifecycle").when(F.col("amount").isNull(), "missing_amount").when(F.col("is_revocation"), "revocation_decision")
    marked = g.withColumn("exclusion_reason", reason)
    largest = F.min_by(F.struct("amount", "issue_date"), F.struct(-F.col("amount"), ~F.col("is_canonical"), F.coalesce(F.col("issue_date").cast("string"), F.lit("")), F.coalesce("ada", F.lit(""))))
    ranked = marked.filter("exclusion_reason is null").groupBy("canonical_id").agg(largest.alias("p"))
    included = ranked.orderBy(F.desc("p.amount"), F.desc("p.issue_date"), "canonical_id").limit(top).select("canonical_id", F.lit(True).alias("__in"))  # ``top`` rows
    j = marked.join(F.broadcast(included), "canonical_id", "left")
    return j.withColumn("exclusion_reason", F.coalesce("exclusion_reason", F.when(F.col("__in").isNull(), F.lit(f"outside_top_{top}")))).drop("__in")


def revocations(d: DataFrame, order: Column) -> DataFrame:
    """Decisions with revoked_by: the last (by ``order``) of those whose revokes_ada names them, whatever their case."""
    by = d.filter("revokes_ada is not null").groupBy(F.upper("revokes_ada").alias("__t")).agg(F.max_by("ada", order).alias("revoked_by"))
    return d.join(by, F.upper("ada") == F.col("__t"), "left").drop("__t")

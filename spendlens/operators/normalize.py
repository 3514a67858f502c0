"""Raw exports and details to the decision table, and its upkeep: recovered amounts, duplicates, merges and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import json_fields as J
from ..functions import vocabulary as V
from ..functions.classify import decision_type, procurement_stage
from ..functions.dates import iso_date
from ..functions.ids import detail_url, normalize_tax_id
from ..functions.numbers import budget_in_subject

DECISION_COLUMNS = ("org", "year", "month", "procurement_stage", "ada", "issue_date", "issue_date_raw", "decision_type", "subject", "url", "amount", "amount_source", "supplier_name", "supplier_tax_id", "signer", "unit", "detail_enriched")


def normalize_decisions(exports: DataFrame, details: DataFrame) -> DataFrame:
    """The decision table of exports (org, year, month, ada, record) with what details (org, year, month, ada, detail) add.

    A detail goes before the export for each field; amounts are looked for in the detail, then the export, then a budget in
    the subject, and say where they come from. Rows keep apart until `keep_first` or `keep_richest`.
    """
    rows = exports.join(details, ["org", "year", "month", "ada"], "left")
    d, e = F.col("__dm"), F.col("__em")
    text = lambda keys: F.coalesce(J.named_first(d, F.col("__d"), keys), J.named_first(e, F.col("__e"), keys))["text"]
    # Each record is searched in its own row, so nothing has to find back to it.
    rows = rows.withColumns({"__dm": J.as_map(F.col("detail")), "__em": J.as_map(F.col("record")), "__d": J.sought(F.col("detail")), "__e": J.sought(F.col("record"))})
    both = F.when(F.col("detail").isNotNull(), F.concat("__d", "__e")).otherwise(F.col("__e"))
    rows = rows.withColumns({
        "__da": J.amounts(F.col("__d")), "__ea": J.amounts(F.col("__e")), "__ds": J.supplier_fields(F.col("__d")), "__es": J.supplier_fields(F.col("__e")),
        "signer": J.labelled_text(both, V.SIGNER_KEYS, V.SIGNER_LABELS), "unit": J.labelled_text(both, V.UNIT_KEYS, V.UNIT_LABELS),
        "subject": F.coalesce(J.subject(d), J.subject(e)), "issue_date_raw": text(V.DATE_KEYS), "decision_type": decision_type(text(V.TYPE_KEYS), text(V.TYPE_LABEL_KEYS)), "url": text(V.URL_KEYS),
    })
    budget = budget_in_subject(F.col("subject"))
    of = lambda prefix, a: F.when(a.isNotNull(), F.concat(F.lit(prefix), a["path"]))
    source = F.coalesce(of("detail:", F.col("__da")), of("search_export:", F.col("__ea")), F.when(budget.isNotNull(), F.lit("subject:trusted_budget_phrase")))
    return rows.select(
        "org", "year", "month", procurement_stage(F.col("subject")).alias("procurement_stage"), "ada", iso_date(F.col("issue_date_raw")).alias("issue_date"), "issue_date_raw",
        "decision_type", "subject", detail_url(F.col("ada"), F.col("url")).alias("url"), F.coalesce("__da.amount", "__ea.amount", budget).alias("amount"), source.alias("amount_source"),
        F.coalesce("__ds.supplier_name", "__es.supplier_name").alias("supplier_name"), normalize_tax_id(F.coalesce("__ds.supplier_tax_id", "__es.supplier_tax_id")).alias("supplier_tax_id"), "signer", "unit", F.col("detail").isNotNull().alias("detail_enriched"),
    )


def keep_first(d: DataFrame, order: list[Column | str], key: str = "ada") -> DataFrame:
    """Of rows with one key the first in a total order; rows without a key are one."""
    return d.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("__n = 1").drop("__n")


def keep_richest(d: DataFrame, score: Column, order: list[str], key: str = "ada") -> DataFrame:
    """Of rows with one key the one with the most filled, its nulls filled from the next; rows without a key all stay. duplicates: how many it stands for."""
    kind = d.select(score.alias("s")).schema["s"].dataType
    least = F.struct(*[-score[f] for f in kind.names]) if isinstance(kind, T.StructType) else -score  # a score may be several numbers
    named = d.filter(F.col(key).isNotNull()).withColumn("__by", F.struct(least.alias("s"), *order))
    rest = [c for c in d.columns if c != key]
    # Of each column the value of the first row that has one: aggregates, so that a key's rows meet partly before the shuffle.
    filled = named.groupBy(key).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("__by"))).alias(c) for c in rest], F.count("*").alias("duplicates"))
    alone = d.filter(F.col(key).isNull()).withColumn("duplicates", F.lit(1).cast("long"))
    return filled.unionByName(alone.select(key, *rest, "duplicates"))


def merge_windows(existing: DataFrame, fetched: DataFrame, key: str = "ada") -> DataFrame:
    """Existing rows, and the fetched ones whose key they lack, each once: of several the least in all columns."""
    new = keep_first(fetched, sorted(fetched.columns), key).join(existing.select(key).distinct(), key, "left_anti")
    return existing.unionByName(new.select(existing.columns))


def repeated_keys(d: DataFrame, key: str = "ada") -> DataFrame:
    """Keys that are there more than once."""
    return d.filter(F.col(key).isNotNull()).groupBy(key).count().filter("count > 1")


def assert_unique(d: DataFrame, key: str = "ada") -> DataFrame:
    """``d``, if every key is there once; else an error with some that are not."""
    if some := repeated_keys(d, key).limit(5).collect():
        raise ValueError("repeated keys: " + ", ".join(str(r[0]) for r in some))
    return d


def typed_patches(details: DataFrame) -> DataFrame:
    """(ada, amount, supplier_name, supplier_tax_id) of details by their decision type, one for each decision: of several details the least one that has the field."""
    rows = details.select("ada", "detail", *[c.alias(n) for n, c in J.typed_fields(F.col("detail")).items()])
    return rows.groupBy("ada").agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("detail"))).alias(c) for c in ("amount", "supplier_name", "supplier_tax_id")])


def patch(d: DataFrame, patches: DataFrame) -> DataFrame:
    """Decisions with amounts that were null or 0 (and are above 0 in a patch), names and tax ids that were blank filled in."""
    p = patches.select(F.col("ada"), *[F.col(c).alias(f"__{c}") for c in ("amount", "supplier_name", "supplier_tax_id")])
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    j = d.join(p, "ada", "left")
    empty = (F.coalesce("amount", F.lit(0.0)) == 0) & (F.col("__amount") > 0)
    j = j.withColumns({"amount": F.when(empty, F.col("__amount")).otherwise(F.col("amount")), "supplier_name": F.coalesce(blank("supplier_name"), "__supplier_name"), "supplier_tax_id": F.coalesce(blank("supplier_tax_id"), normalize_tax_id(F.col("__supplier_tax_id")))})
    return j.select(d.columns)


def backfill(d: DataFrame, details: DataFrame, fields: list[str], key: str = "ada") -> DataFrame:
    """``d`` with fields that are null filled from details (one row for each key)."""
    p = details.select(key, *[F.col(c).alias(f"__{c}") for c in fields])
    return d.join(p, key, "left").withColumns({c: F.coalesce(c, f"__{c}") for c in fields}).select(d.columns)


def index_with_details(index: DataFrame, hydrated: DataFrame, order: list[Column | str], key: str = "ada") -> DataFrame:
    """The index with what the first hydrated row of each decision has, where that is not null."""
    one = keep_first(hydrated, order, key)
    shared = [c for c in index.columns if c in hydrated.columns and c != key]
    more = [c for c in hydrated.columns if c not in index.columns]
    p = one.select(key, *[F.col(c).alias(f"__{c}") for c in shared], *more)
    return index.join(p, key, "left").withColumns({c: F.coalesce(f"__{c}", c) for c in shared}).drop(*[f"__{c}" for c in shared])


def names_of(d: DataFrame, ids: str, names: DataFrame, out: str, key: str = "ada") -> DataFrame:
    """``d`` with the names of an id array, joined by commas in the ids' order. names: id, name."""
    rows = d.select(key, F.posexplode(ids).alias("__pos", "id")).join(names, "id").filter("name is not null")
    found = rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__pos", "name"))), lambda x: x["name"]), ", ").alias(out))
    return d.join(found, key, "left")


def malformed(d: DataFrame, *required: str) -> tuple[DataFrame, DataFrame]:
    """Decisions that have all required fields, and those that lack some, with their names."""
    from ..functions.classify import missing_fields

    marked = d.withColumn("missing_fields", missing_fields(*required))
    return marked.filter(F.size("missing_fields") == 0).drop("missing_fields"), marked.filter(F.size("missing_fields") > 0)


def searched(d: DataFrame, org: str | None = None, types: list[str] | None = None, words: str | None = None, first=None, last=None, date: str = "issue_date") -> DataFrame:
    """Decisions of an organisation, types, a word of the subject and a range of dates; what is not given does not count."""
    for given, condition in ((org, F.col("org") == org), (types, F.col("decision_type").isin(*(types or [""]))), (words, F.contains(F.lower("subject"), F.lower(F.lit(words or "")))), (first, F.col(date) >= F.lit(first)), (last, F.col(date) <= F.lit(last))):
        if given is not None:
            d = d.filter(condition)
    return d

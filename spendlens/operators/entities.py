"""Suppliers as entities: rollups, clusters, rankings, registry enrichment and flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.classify import supplier_type_of
from ..functions.ids import hashed_id, normalize_tax_id, supplier_key
from ..functions.numbers import number_or
from ..functions.text import canonical_supplier_name, canonical_text, supplier_name_normalized

LOW_CAPITAL, HIGH_SPEND, RECENT_DAYS = 10_000, 100_000, 365


def keyed(d: DataFrame) -> DataFrame:
    """Decisions with supplier_key, supplier_name_normalized and supplier_tax_id normalised."""
    tax = normalize_tax_id(F.col("supplier_tax_id"))
    return d.withColumns({"supplier_key": supplier_key(F.col("supplier_name"), F.col("supplier_tax_id")), "supplier_name_normalized": supplier_name_normalized(F.col("supplier_name")), "supplier_tax_id": tax})


def with_supplier_normalization(d: DataFrame) -> DataFrame:
    """Decisions with the canonical supplier name, kind and the confidence of the normalisation (1 by tax id, 0.9 by name, else 0)."""
    tax, name = normalize_tax_id(F.col("supplier_tax_id")), F.col("supplier_canonical")
    return d.withColumn("supplier_canonical", canonical_supplier_name(F.col("supplier_name"))).withColumns({
        "supplier_type": supplier_type_of(name, F.col("supplier_tax_id")),
        "normalization_confidence": F.when(tax.isNotNull(), 1.0).when(name.isNotNull(), 0.9).otherwise(0.0),
    })


def suppliers(d: DataFrame) -> DataFrame:
    """One row for each supplier_key of keyed decisions: first name and tax id in order of date and id, dates, distinct decisions, amount."""
    order = F.struct("issue_date", "ada")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), order))
    return d.filter("supplier_key is not null").groupBy("supplier_key").agg(
        first("supplier_name_normalized").alias("supplier_name_normalized"), first("supplier_tax_id").alias("supplier_tax_id"),
        F.min("issue_date").alias("first_seen"), F.max("issue_date").alias("last_seen"),
        F.count_distinct("ada").alias("decision_count"), F.coalesce(F.sum("amount"), F.lit(0.0)).alias("total_amount"),
    )


def clusters(s: DataFrame) -> DataFrame:
    """Suppliers that are one: by tax id, else by canonical name, else each alone; the longest name stands for all."""
    tax, name = normalize_tax_id(F.col("supplier_tax_id"), embedded=False), F.nullif(canonical_text(F.col("supplier_name_normalized")), F.lit(""))
    g = s.withColumns({"__tax": tax, "__group": F.coalesce(F.concat(F.lit("t:"), tax), F.concat(F.lit("n:"), name), F.concat(F.lit("k:"), F.col("supplier_key")))})
    longest = F.struct(F.length("supplier_name_normalized"), "supplier_name_normalized")
    c = g.groupBy("__group").agg(
        F.max_by("supplier_name_normalized", longest).alias("canonical_name"), F.min("__tax").alias("supplier_tax_id"),
        F.array_sort(F.collect_set("supplier_key")).alias("member_keys"), F.sum("decision_count").alias("decision_count"),
        F.sum("total_amount").alias("total_amount"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
    )
    key = F.coalesce("supplier_tax_id", F.nullif("canonical_name", F.lit("")), F.array_join("member_keys", "|"))
    return c.select(hashed_id("cluster:", key).alias("cluster_id"), "canonical_name", "supplier_tax_id", "member_keys", "decision_count", "total_amount", "first_seen", "last_seen")


def cluster_procurements(c: DataFrame, p: DataFrame) -> DataFrame:
    """(cluster_id, procurement's columns): by member key or by tax id, each procurement once in a cluster."""
    # A procurement gets the clusters of its key and of its tax id side by side, so it is no more than one row before it meets its like.
    by_key = c.select("cluster_id", F.explode("member_keys").alias("__k")).groupBy("__k").agg(F.collect_set("cluster_id").alias("__a"))
    by_tax = c.filter("supplier_tax_id is not null").groupBy(F.col("supplier_tax_id").alias("__t")).agg(F.collect_set("cluster_id").alias("__b"))
    j = p.join(by_key, p["supplier_key"] == F.col("__k"), "left").join(by_tax, p["supplier_tax_id"] == F.col("__t"), "left")
    none = F.array().cast("array<string>")
    found = F.array_union(F.coalesce("__a", none), F.coalesce("__b", none))
    return j.select(F.explode(found).alias("cluster_id"), *[p[x] for x in p.columns]).dropDuplicates()


def intelligence(d: DataFrame) -> DataFrame:
    """Distinct decisions, sum, mean and dates by supplier key and name; a null name is a name."""
    g = d.filter("supplier_key is not null").groupBy("supplier_key", "supplier_name")
    return g.agg(F.count_distinct("ada").alias("decisions"), F.sum("amount").alias("total_amount"), F.avg("amount").alias("avg_amount"), F.min("issue_date").alias("first_seen"), F.max("issue_date").alias("last_seen"))


def rankings(d: DataFrame, top: int = 20, without_types: tuple[str, ...] = ()) -> DataFrame:
    """The top suppliers by amount and by number of decisions, in one table with rank columns (null: not among them)."""
    d = d.filter("supplier_key is not null")
    if without_types:
        d = d.filter(~F.col("supplier_type").isin(*without_types))
    s = d.groupBy("supplier_key").agg(F.min("supplier_name").alias("supplier_name"), F.count("*").alias("decision_count"), F.count("amount").alias("amount_decision_count"), F.round(F.coalesce(F.sum("amount"), F.lit(0.0)), 2).alias("total_amount"))
    amount = [F.desc("total_amount"), F.desc("amount_decision_count"), F.desc("decision_count"), F.desc("supplier_name"), F.desc("supplier_key")]
    count = [F.desc("decision_count"), F.desc("total_amount"), F.desc("supplier_name"), F.desc("supplier_key")]

    def best(order: list, rank: str) -> DataFrame:
        return s.orderBy(*order).limit(top).select("*", F.row_number().over(Window.orderBy(*order)).alias(rank))  # ``top`` rows

    names = ["supplier_key", "supplier_name", "decision_count", "amount_decision_count", "total_amount"]
    return best(amount, "amount_rank").join(best(count, "count_rank"), names, "full")


def enrich(s: DataFrame, registry: DataFrame) -> DataFrame:
    """Suppliers with a tax id, one row for each, with their registry record and flags.

    registry: supplier_tax_id, lookup_status, is_active, share_capital, registration_date (date). A supplier without a record,
    or whose lookup found none, has only flag_no_record.
    """
    one = s.filter("supplier_tax_id is not null").groupBy("supplier_tax_id").agg(F.min_by(F.struct("supplier_key", "total_amount", "first_seen"), "supplier_key").alias("s")).select("supplier_tax_id", "s.*")
    r = one.join(registry, "supplier_tax_id", "left")
    found = F.coalesce(F.col("lookup_status") != "not_found", F.lit(False))
    days = F.datediff("first_seen", "registration_date")
    flag = lambda c: found & F.coalesce(c, F.lit(False))
    return r.withColumns({
        "flag_no_record": ~found,
        "flag_inactive": flag(~F.col("is_active")),
        "flag_low_capital": flag((number_or(F.col("share_capital")) < LOW_CAPITAL) & (F.col("total_amount") > HIGH_SPEND)),
        "flag_recently_registered": flag(days.between(0, RECENT_DAYS)),
    })


def flag_totals(enriched: DataFrame) -> DataFrame:
    """How many suppliers have each flag, and any."""
    flags = ("flag_no_record", "flag_inactive", "flag_low_capital", "flag_recently_registered")
    return enriched.agg(*[F.count_if(f).alias(f) for f in flags], F.count_if(F.expr(" or ".join(flags))).alias("flagged_suppliers"), F.count("*").alias("suppliers"))


def subset(df: DataFrame, key: str, ids: list[str] | None = None, top: int | None = None, by: str = "total_amount") -> DataFrame:
    """The rows with one of some ids, or the top ones by an amount, ties by key; all if neither is given."""
    if ids is not None:
        df = df.filter(F.col(key).isin(*ids))
    return df if top is None else df.orderBy(F.desc_nulls_last(by), key).limit(top)


def not_yet(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The rows whose key is not done."""
    return wanted.join(done.select(key).distinct(), key, "left_anti")


def dossier(p: DataFrame, top: int = 20) -> DataFrame:
    """One row for each cluster of (cluster_id, procurement): counts, sums, amounts by year, decisions by type, largest procurements."""
    by_year = p.groupBy("cluster_id", "year").agg(F.sum("amount").alias("a")).groupBy("cluster_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("year", "a")))).alias("amount_by_year"))
    by_type = p.groupBy("cluster_id", "decision_type").agg(F.count("*").alias("n")).groupBy("cluster_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("decision_type", "n")))).alias("decision_types"))
    w = Window.partitionBy("cluster_id").orderBy(F.desc_nulls_last("amount"), "ada")
    best = p.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= top)
    best = best.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("__n", "ada", "amount"))), lambda x: F.struct(x["ada"].alias("ada"), x["amount"].alias("amount"))).alias("top_procurements"))
    total = p.groupBy("cluster_id").agg(F.count("*").alias("procurements"), F.sum("amount").alias("total_amount"), F.avg("amount").alias("avg_amount"), F.max("amount").alias("max_amount"))
    return total.join(by_year, "cluster_id").join(by_type, "cluster_id").join(best, "cluster_id")

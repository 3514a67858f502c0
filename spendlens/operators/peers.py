"""Organisations against their peers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V

LEAST_COVERAGE = 10.0


def _of(kind: str):
    return {"direct": F.col("decision_type").isin(*V.DIRECT_AWARD_TYPES) | F.contains("decision_type", F.lit(V.DIRECT_LABEL)), "competitive": (F.col("decision_type") == "Contract award") | F.contains("decision_type", F.lit(V.COMPETITIVE_LABEL)), "contract": (F.col("decision_type") == "Contract signing") | F.contains("decision_type", F.lit(V.CONTRACT_LABEL))}[kind]


def organisation_statistics(d: DataFrame) -> DataFrame:
    """Of each org its decisions, and counts and known amounts of direct, competitive and contract decisions, and of all three."""
    kinds = ("direct", "competitive", "contract")
    aggs = [F.count("*").alias("decisions")]
    for k in kinds:
        aggs += [F.count_if(_of(k)).alias(f"{k}_count"), F.count(F.when(_of(k), F.col("amount"))).alias(f"{k}_known"), F.coalesce(F.sum(F.when(_of(k), F.col("amount"))), F.lit(0.0)).alias(f"{k}_amount")]
    spent = _of("direct") | _of("competitive") | _of("contract")
    return d.groupBy("org").agg(*aggs, F.count(F.when(spent, F.col("amount"))).alias("spend_known"), F.coalesce(F.sum(F.when(spent, F.col("amount"))), F.lit(0.0)).alias("spend"))


def direct_by_year(d: DataFrame, orgs: list[str]) -> DataFrame:
    """Direct awards of each year, a column for each org, and what they are of that year's decisions in per cent."""
    g = d.groupBy("year").pivot("org", orgs).agg(F.count_if(_of("direct")).alias("direct"), F.try_divide(F.count_if(_of("direct")) * 100, F.count(F.lit(1))).alias("pct"))
    return g.fillna(0, [f"{o}_direct" for o in orgs])


def comparison(stats: DataFrame, least_coverage: float = LEAST_COVERAGE) -> DataFrame:
    """Direct to competitive, direct of decisions and of spend in per cent; those of spend only where enough amounts are known."""
    enough = F.try_divide(F.col("spend_known") * 100, F.col("direct_count") + F.col("competitive_count") + F.col("contract_count")) >= least_coverage
    return stats.select("org", F.try_divide("direct_count", "competitive_count").alias("direct_to_competitive"), F.try_divide(F.col("direct_count") * 100, "decisions").alias("direct_pct"), F.when(enough, F.try_divide(F.col("direct_amount") * 100, "spend")).alias("direct_spend_pct"))


def against_peers(stats: DataFrame, org: str, measure: str, keep_zero: bool = True) -> DataFrame:
    """One org's measure, the mean of the others' (those with 0 left out or not), and their ratio."""
    others = stats.filter(F.col("org") != org) if keep_zero else stats.filter((F.col("org") != org) & (F.col(measure) != 0))
    mean = others.agg(F.avg(measure).alias("peer_mean"), F.count("*").alias("peers")).withColumn("__one", F.lit(1))
    own = stats.filter(F.col("org") == org).select("org", F.col(measure).cast("double").alias("own")).withColumn("__one", F.lit(1))
    return own.join(mean, "__one").drop("__one").withColumn("times", F.try_divide("own", "peer_mean"))

"""Publication-delay indicators by month, and their comparison over periods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.dates import delay_days
from ..functions.numbers import percent_change
from .rolling import quantiles


def with_delay(d: DataFrame, start: str = "issue_ts", end: str = "publish_ts") -> DataFrame:
    """Decisions with delay, in days."""
    return d.withColumn("delay", delay_days(F.col(start), F.col(end)))


def indicators(d: DataFrame, *by: str) -> DataFrame:
    """Count, median and 90th percentile of the delay, and shares without publication or organisation, in per cent."""
    pct = lambda c: F.try_divide(F.count_if(F.col(c).isNull()) * 100, F.count("*"))
    g = d.groupBy(*by).agg(F.count("*").alias("decisions"), pct("publish_ts").alias("pct_no_publication"), pct("org").alias("pct_no_org"))
    g = _beside(g, quantiles(d, list(by), "delay", {"median_delay": 0.5, "p90_delay": 0.9}), list(by))
    return g.select(*by, "decisions", "median_delay", "p90_delay", "pct_no_publication", "pct_no_org")


def _beside(g: DataFrame, q: DataFrame, by: list[str]) -> DataFrame:
    """Groups with their quantiles; groups may be null."""
    more = [c for c in q.columns if c not in by]
    q = q.select(*[F.col(c).alias(f"__{c}") for c in by], *more)
    return g.join(q, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by] if by else F.lit(True), "left").drop(*[f"__{c}" for c in by])  # without groups one row each


def type_mix(d: DataFrame, top: int = 5) -> DataFrame:
    """The most frequent decision types and their share in per cent."""
    g = d.groupBy("decision_type").agg(F.count("*").alias("decisions"))
    return g.withColumn("pct", F.col("decisions") * 100 / F.sum("decisions").over(Window.partitionBy())).orderBy(F.desc("decisions"), "decision_type").limit(top)


def monthly_trend(d: DataFrame) -> DataFrame:
    """Of each month the count and median delay, the means of the last 6 and 12 months' counts, and the counts of the three months before."""
    m = _beside(d.groupBy("year", "month").agg(F.count("*").alias("decisions")), quantiles(d, ["year", "month"], "delay", {"median_delay": 0.5}), ["year", "month"])
    w = Window.orderBy("year", "month")  # one row a month
    back = lambda n: F.avg("decisions").over(w.rowsBetween(1 - n, 0))
    return m.select("year", "month", "decisions", "median_delay", back(6).alias("mean_6"), back(12).alias("mean_12"), *[F.lag("decisions", k).over(w).alias(f"m_{k}") for k in (1, 2, 3)])


def period_comparison(d: DataFrame, year: int, month: int) -> DataFrame:
    """A month against the month before, the same month a year before, and the year to date against the last one's: one scan, one row."""
    now, at = year * 12 + month - 1, F.col("year") * 12 + F.col("month") - 1
    this_year, last_year = (F.col("year") == year) & (F.col("month") <= month), (F.col("year") == year - 1) & (F.col("month") <= month)
    scopes = {"month": at == now, "previous": at == now - 1, "year_before": at == now - 12, "ytd": this_year, "ytd_before": last_year}
    some = d.filter(F.col("year").isin(year, year - 1))
    c = some.agg(*[F.count_if(s).alias(n) for n, s in scopes.items()])
    scope = some.withColumn("__scope", F.when(scopes["month"], "median_delay").when(scopes["previous"], "median_delay_previous")).filter("__scope is not null")
    medians = quantiles(scope, ["__scope"], "delay", {"q": 0.5}).agg(*[F.max(F.when(F.col("__scope") == n, F.col("q"))).alias(n) for n in ("median_delay", "median_delay_previous")])
    c = c.join(medians, F.lit(True))  # one row each
    return c.withColumns({"mom_pct": percent_change(F.col("month"), F.col("previous")), "yoy_pct": percent_change(F.col("month"), F.col("year_before")), "ytd_pct": percent_change(F.col("ytd"), F.col("ytd_before"))})


def unmapped_types(d: DataFrame, known: list[str]) -> DataFrame:
    """Decision types that no label is known for, and how often they occur."""
    return d.filter(~F.col("decision_type").isin(*known)).groupBy("decision_type").agg(F.count("*").alias("mentions"))


def slowest(d: DataFrame, top: int = 10) -> DataFrame:
    """The decisions published last after their issue, each id once."""
    one = d.filter("delay is not null").groupBy("ada").agg(F.max("delay").alias("delay"))
    return one.orderBy(F.desc("delay"), "ada").limit(top)

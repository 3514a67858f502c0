"""Sums over a sliding window of days, and exact quantiles, without one task for a whole key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .durable import cut, stored

#: Windows of days in one stretch of time: a task holds the daily sums of a stretch and of one window before or behind it.
STRETCH = 16
#: Distinct values of a group up to which one task may hold them; parts that a range of values is cut into each round of the search for a rank.
SMALL, PARTS, MAX_ROUNDS = 100_000, 64, 16


def daily(d: DataFrame, keys: list[str], sums: dict[str, Column], day: str = "issue_date") -> DataFrame:
    """One row for each key and day with the given aggregates and ``day`` as a number of days: partial before the shuffle."""
    return d.filter(F.col(day).isNotNull()).groupBy(*keys, F.unix_date(day).alias("day")).agg(*[c.alias(n) for n, c in sums.items()])


def over_days(days: DataFrame, keys: list[str], first: int, last: int, sums: dict[str, Column]) -> DataFrame:
    """Daily rows with aggregates over the days from ``first`` to ``last`` around each (0 is the day itself).

    Time is cut into stretches of STRETCH windows, whatever the key. A day goes to its own stretch and, as a lender, to those whose days
    its window reaches, so windows are worked out by key and stretch: a key's whole history is never in one task.
    """
    width = max(1, (last - first) * STRETCH)
    stretch = lambda c: F.floor(c / F.lit(width))
    seen_by = F.sequence(stretch(F.col("day") - last), stretch(F.col("day") - first))
    rows = days.withColumn("__own", stretch(F.col("day"))).withColumn("__at", F.explode(F.array_union(seen_by, F.array(stretch(F.col("day"))))))
    w = Window.partitionBy(*keys, "__at").orderBy("day").rangeBetween(first, last)
    return rows.withColumns({n: c.over(w) for n, c in sums.items()}).filter("__at = __own").drop("__at", "__own")


def quantiles(d: DataFrame, by: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """(by, names of ``at``): the exact quantiles of a value in each group, interpolated between the two ranks around them; as ``percentile`` has them.

    Values are counted first, so equal ones are one. Groups of over SMALL distinct values are searched for their ranks, all at once: each
    round counts a group's values in PARTS parts of the range that is left, partial before the shuffle, and goes on in the part that holds
    the rank, until a range holds one distinct value. No task holds such a group's values. Null and NaN values do not count; a group
    without any has null. Nulls in ``by`` are a group.
    """
    keys = [F.coalesce(F.to_json(F.struct(*by)), F.lit("")) if by else F.lit("")]
    rows = d.select(*by, keys[0].alias("__g"), F.col(value).cast("double").alias("v")).withColumn("v", F.when(~F.isnan("v"), F.col("v") + F.lit(0.0)))
    rows = stored(rows.filter("v is not null").groupBy("__g", "v").agg(F.count("*").alias("n")))
    ends = cut(rows.groupBy("__g").agg(F.sum("n").alias("total"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("distinct")))
    small = ends.filter(F.col("distinct") <= SMALL).select("__g")
    one = rows.join(small, "__g").groupBy("__g").agg(*[F.percentile("v", F.lit(float(q)), F.col("n")).alias(n) for n, q in at.items()])
    large = ends.filter(F.col("distinct") > SMALL)
    if not large.isEmpty():
        one = one.unionByName(_searched(rows, large, at))
    groups = d.select(*by).distinct() if by else d.sparkSession.range(1).select()
    return groups.withColumn("__g", keys[0]).join(one, "__g", "left").drop("__g")


def _searched(rows: DataFrame, ends: DataFrame, at: dict[str, float]) -> DataFrame:
    """(__g, names of ``at``) by refining ranges."""
    names = list(at)
    wanted = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(w).alias("w"), (F.lit(float(q)) * (F.col("total") - 1)).alias("p")) for n, q in at.items() for w in (0, 1)]))
    # For each quantile the rank below it and the one above: rank counts from 0, below is what lies under the range.
    open_ = ends.select("__g", "lo", "hi", wanted.alias("s")).select("__g", "lo", "hi", "s.*")
    open_ = cut(open_.select("__g", "name", "w", "p", F.when(F.col("w") == 0, F.floor("p")).otherwise(F.ceil("p")).alias("rank"), "lo", "hi", F.lit(0).cast("long").alias("below")))
    done = []
    for _ in range(MAX_ROUNDS):
        settled = open_.filter("lo = hi")
        done.append(settled.select("__g", "name", "w", "p", F.col("lo").alias("v")))
        open_ = open_.filter("lo < hi")
        if open_.isEmpty():
            break
        ranges = open_.select("__g", "lo", "hi").distinct()
        part = F.least(F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * PARTS), F.lit(PARTS - 1))  # halves: the range may be wider than a double
        inside = rows.join(ranges, "__g").filter("v between lo and hi").withColumn("part", part)
        counts = inside.groupBy("__g", "lo", "hi", "part").agg(F.sum("n").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
        w = Window.partitionBy("__g", "lo", "hi").orderBy("part")  # PARTS rows at most
        counts = counts.withColumn("before", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        met = open_.join(counts, ["__g", "lo", "hi"]).withColumn("under", F.col("below") + F.col("before"))
        met = met.filter("rank >= under and rank < under + n")
        open_ = cut(met.select("__g", "name", "w", "p", "rank", F.col("least").alias("lo"), F.col("most").alias("hi"), F.col("under").alias("below")))
    else:
        # Values so close that equal parts do not part them: what is left of a group is a range of neighbouring doubles or outliers' remains.
        left = rows.join(open_, "__g").filter("v between lo and hi").withColumn("upto", F.col("below") + F.sum("n").over(Window.partitionBy("__g", "name", "w").orderBy("v")))
        done.append(left.filter("upto > rank").groupBy("__g", "name", "w", "p").agg(F.min("v").alias("v")))
    found = done[0]
    for x in done[1:]:
        found = found.unionByName(x)
    both = found.groupBy("__g", "name").agg(F.max("p").alias("p"), F.max(F.when(F.col("w") == 0, F.col("v"))).alias("a"), F.max(F.when(F.col("w") == 1, F.col("v"))).alias("b"))
    between = F.when(F.floor("p") == F.ceil("p"), F.col("a")).otherwise((F.ceil("p") - F.col("p")) * F.col("a") + (F.col("p") - F.floor("p")) * F.col("b"))
    return both.select("__g", "name", between.alias("q")).groupBy("__g").agg(*[F.max(F.when(F.col("name") == n, F.col("q"))).alias(n) for n in names])

"""Mixing sources to target weights by a time-varying curriculum, in DataFrame functions only.

Each source has a target number of words (its weight's share of all words, never
above ``MAX_REPEATS`` times its own) and a weight schedule over training time
t in 0..1, ``target * (1 + slope * (2 t - 1))``. The schedule's integral is the
source's cumulative demand ``target * (t + slope * (t * t - t))``; a document
that stands at cumulative word c of its source's stream is due when the demand
reaches c, so inverting the integral gives its training position, and a range
sort by position gives the training order.

The stream of a source is its documents in a fixed pseudo-random order (md5 of
the id), as often over as the target asks, the last pass cut at the target's word.
Cumulative words come from totals of (source, md5 prefix) ranges and a running
sum inside each range, so a source with a third of all rows is spread over all tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, cut, row_hash, text_of

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
SLOPES = (0.5, 0.0, -0.5)
ROWS_PER_RANGE = 4096
ADDED = ("size", "source_size", "target", "taken", "position")


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with size, the number of words of the text (null: 0)."""
    return docs.withColumn("size", F.regexp_count(text_of(text), F.lit(WORD)).cast("long"))


def source_targets(sizes: DataFrame, source: str = "source") -> DataFrame:
    """(source, source_size, target, slope) from rows of (source, size).

    Sources in code point order, null last, weigh WEIGHTS in turn and share all words by weight. A target above
    MAX_REPEATS times its source's words stops there and the excess is shared by weight again: with sources sorted by
    cap per weight, the first whose share of what the capped ones leave fits under its cap ends the capping.
    """
    by = Window.orderBy(F.col(source).asc_nulls_last())  # rows here: one per source
    order = Window.orderBy("ratio", "place")
    s = sizes.groupBy(source).agg(F.sum("size").alias("source_size"))
    s = s.withColumn("place", F.row_number().over(by))
    turn = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(F.col("place") - 1, F.lit(len(values))) + 1).cast("int"))
    s = s.withColumns({"weight": turn(WEIGHTS).cast("long"), "slope": turn(SLOPES), "total": F.sum("source_size").over(Window.partitionBy())})
    s = s.withColumn("ratio", MAX_REPEATS * F.col("source_size").cast("double") / F.col("weight"))
    s = s.withColumns({
        "capped": F.coalesce(F.sum(MAX_REPEATS * F.col("source_size")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "left": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)),
    })
    s = s.withColumn("level", (F.col("total") - F.col("capped")).cast("double") / F.col("left"))
    s = s.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "place", "level"))).over(Window.partitionBy())["level"])
    return s.select(source, "source_size", F.least(MAX_REPEATS * F.col("source_size").cast("double"), F.col("level") * F.col("weight")).alias("target"), "slope")


def mix(docs: DataFrame, source: str = "source", id_col: str = "doc_id") -> DataFrame:
    """``docs`` (with size) plus source_size, target, taken (words the mix takes, repeats counted) and position.

    taken is between 0 and MAX_REPEATS times size; of a source it adds up to its target rounded to a word. position in 0..1
    is where the document first comes up, null if it is not taken. Null sources are one source, the last; null and
    wordless texts have size 0 and are not taken; rows with the same id follow one another. Columns of the added names are
    replaced, other names may be any. Empty table: empty result.
    """
    docs = docs.drop(*[c for c in ADDED if c != "size"])
    # The row as it is travels in one column, so that its names meet none of ours.
    rows = docs.select(F.struct("*").alias("row"), F.col(source).alias("source"), F.col("size"), F.col(id_col).alias("id"))
    return placed(rows).select("row.*", "source_size", "target", "taken", "position")


def placed(docs: DataFrame) -> DataFrame:
    """Rows of (source, size, id) plus source_size, target, slope, taken, position and __before, the words of the source before the row."""
    sizes = docs.select("source", "size", "id")
    digits = max(1, math.ceil(math.log(max(1, sizes.count()) / ROWS_PER_RANGE, 16))) if sizes.take(1) else 1
    order = F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary"))
    chunk = F.substring(order, 1, digits)

    targets = source_targets(sizes)
    ranges = sizes.groupBy(F.col("source").alias("__s"), chunk.alias("__range")).agg(F.sum("size").alias("__words"))
    before = Window.partitionBy("__s").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("__s", "__range", F.coalesce(F.sum("__words").over(before), F.lit(0)).alias("__start"))
    ranges = ranges.join(targets.withColumnRenamed("source", "__t"), F.col("__s").eqNullSafe(F.col("__t"))).drop("__t")

    inside = Window.partitionBy("source", "__range").orderBy("__order", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    df = docs.withColumns({"__order": order, "__range": chunk})
    df = df.withColumn("__before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    df = df.join(ranges.withColumnRenamed("__range", "__r"), F.col("source").eqNullSafe(F.col("__s")) & (F.col("__range") == F.col("__r"))).drop("__s", "__r", "__range", "__order")
    df = df.withColumn("__before", F.col("__before") + F.col("__start"))
    # Whole passes, and the words of the last one.
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    df = df.withColumn("__passes", passes.cast("long"))
    df = df.withColumn("__rest", F.round(F.col("target") - F.col("__passes") * F.col("source_size")).cast("long"))
    df = df.withColumn("taken", F.col("__passes") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("__rest") - F.col("__before"))))
    return df.withColumn("position", F.when(F.col("taken") > 0, due(F.col("__before") + F.col("size") / 2))).drop("__start", "__passes", "__rest")


def due(words):
    """The training time at which a source's cumulative demand reaches so many words of its stream."""
    u = F.least(F.lit(1.0), words / F.col("target"))
    s = F.col("slope")
    return F.when(s == 0, u).otherwise((s - 1 + F.sqrt((1 - s) * (1 - s) + 4 * s * u)) / (2 * s))


def mixed(docs: DataFrame, text: str = "text", source: str = "source", id_col: str = "doc_id") -> DataFrame:
    """The mix itself: every document as often as at least half of it is taken, in training order, with the columns of ``docs``.

    Positions are worked out on (source, size, id, hash of the row) alone; the rows join them once and are sorted once.
    Rows are known by a 128-bit hash of all their columns (maps: as JSON); those without an id are spread by it.
    """
    packed = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"), F.col(source).alias("source"), F.col(id_col).alias("doc"))
    packed = packed.withColumn("hash", row_hash(packed, "row"))
    sizes = cut(sized(packed.drop("row")).drop("text").withColumn("id", F.coalesce(F.col("doc").cast("string"), F.concat_ws("|", "hash.a", "hash.b"))))
    df = placed(sizes).filter((F.col("taken") > 0) & (F.col("taken") * 2 >= F.col("size")))
    copies = F.sequence(F.lit(0), F.round(F.col("taken") / F.col("size")).cast("int") - 1)
    df = df.withColumn("__copy", F.explode(copies))
    df = df.select("hash", due(F.col("__before") + F.col("__copy") * F.col("source_size") + F.col("size") / 2).alias("at"), "doc", F.col("__copy").alias("copy"))
    # Rows alike in all columns, id and all, are one row here; each of them has its own positions.
    rows = packed.select("hash", "row").dropDuplicates(["hash"])
    return rows.join(df, "hash").orderBy("at", "doc", "copy").select("row.*")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken and position of every document, in training order."""
    sizes = cut(sized(docs.select(F.col("doc_id").alias("id"), "source", "text")).drop("text"))
    return placed(sizes).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "position").orderBy("position", "doc_id")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS o FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source),
w AS (
  SELECT *, (place - 1) % 3 + 1 AS weight, CASE (place - 1) % 3 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 0.0 ELSE -0.5 END AS slope,
         sum(source_size) OVER () AS total, 3 * source_size::DOUBLE / ((place - 1) % 3 + 1) AS ratio FROM s),
c AS (
  SELECT *, (total - coalesce(sum(3 * source_size) OVER (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / sum(weight) OVER (ORDER BY ratio, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
l AS (SELECT arg_min(level, place) AS level FROM (SELECT level, row_number() OVER (ORDER BY ratio, place) AS place FROM c WHERE level <= ratio)),
t AS (SELECT source, source_size, slope, least(3 * source_size::DOUBLE, l.level * weight) AS target FROM c, l),
b AS (
  SELECT d.doc_id, size, source_size, target, slope,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY o, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done,
         CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS passes
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (
  SELECT *, (passes * size + greatest(0, least(size, round(target - passes * source_size)::BIGINT - done)))::BIGINT AS taken,
         least(1.0::DOUBLE, (done + size / 2) / target) AS u FROM b)
SELECT doc_id, size, source_size, target, taken,
       CASE WHEN taken > 0 THEN CASE WHEN slope = 0 THEN u ELSE (slope - 1 + sqrt((1 - slope) * (1 - slope) + 4 * slope * u)) / (2 * slope) END END AS position
FROM k
"""

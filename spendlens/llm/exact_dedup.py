"""Exact dedup by two-pass Bloom filtering, in DataFrame functions only.

Pass one hashes every text to three bits of one 64-bit word of a blocked Bloom
filter and counts how often each bit is hit; the bits hit twice or more are the
filter of *possibly repeated* hashes. Pass two probes every row against it. A
row that misses has a text seen once and passes straight through; the rest (true
copies and a small share of false positives) shuffle on the exact SHA-256.

The filter has at most ``MAX_WORDS`` rows of 16 bytes whatever the input, which
is the size bound of its broadcast. Beyond four rows a word (4 million rows) it
fills up and lets more rows through to the exact step, nearly all from 100 million
rows on; the result stays the same, and the step shuffles hashes, not texts, but
where rows themselves are asked for.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, cut, row_hash, text_of, without

MAX_WORDS = 1 << 20
ROWS_PER_WORD = 4
#: Rows alike in all columns that one task deals out.
BLOCK = 10_000
ADDED = ("keep_id", "group_size", "kept", "text_sha256")


def normalized(text: str = "text") -> Column:
    """The text without ASCII white space; texts are equal when these are identical. Null counts as empty."""
    return F.regexp_replace(text_of(text), WHITE, "")


def keyed(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with text_sha256 of the normalised text and ``__points``, the code points of the original one."""
    return docs.withColumns({"text_sha256": F.sha2(F.encode(normalized(text), "UTF-8"), 256), "__points": F.length(text_of(text)).cast("long")})


def _probe(rows: DataFrame, words: int) -> DataFrame:
    """The Bloom word of each row and the mask of its bits there."""
    h = F.xxhash64("text_sha256")
    bit = lambda n: f"shiftleft(1L, cast(shiftrightunsigned(__h, {n}) & 63 as int))"
    return rows.withColumn("__h", h).withColumns({"__word": F.expr(f"__h & {words - 1}L"), "__mask": F.expr(f"{bit(40)} | {bit(47)} | {bit(54)}")}).drop("__h")


def repeated_filter(keys: DataFrame, words: int) -> DataFrame:
    """Blocked Bloom filter of the hashes seen more than once: (__word, __bits), at most ``words`` rows."""
    bits = F.explode(F.expr("filter(sequence(0, 63), b -> (__mask & shiftleft(1L, b)) <> 0)")).alias("bit")
    hits = _probe(keys, words).select("__word", bits).groupBy("__word", "bit").count().filter("count > 1")
    return hits.groupBy("__word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("__bits"))


def resolve(rows: DataFrame, narrow: DataFrame, id_col: str = "doc_id", order: str = "__tie") -> DataFrame:
    """``rows`` (as from ``keyed``, with ``order`` last in ties) with keep_id, group_size and kept.

    narrow: the same rows' (id, text_sha256, __points, tie), stored once, from which the filter and the groups come.
    """
    n = narrow.count()
    words = 1 << min(int(math.log2(MAX_WORDS)), max(4, math.ceil(math.log2(max(1, n) / ROWS_PER_WORD))))
    bloom = F.broadcast(repeated_filter(narrow, words))  # at most MAX_WORDS rows of 16 bytes

    def flagged(df: DataFrame) -> DataFrame:
        return _probe(df, words).join(bloom, "__word", "left").withColumn("__maybe", F.expr("(coalesce(__bits, 0L) & __mask) = __mask")).drop("__word", "__bits", "__mask")

    # Rows alike in all that decides are counted together first, so that a hot text is pre-aggregated map-side.
    alike = flagged(narrow).filter("__maybe").groupBy("text_sha256", "__points", F.col(id_col).alias("__id"), order).agg(F.count("*").alias("__n"))
    best = F.min(F.struct((-F.col("__points")).alias("p"), F.col("__id").isNull().alias("u"), F.col("__id").alias("i"), F.col(order).alias("o"), F.col("__n").alias("n")))
    # Stored, so that the copies of a hot text can be split in the join below.
    groups = cut(alike.groupBy("text_sha256").agg(F.sum("__n").alias("group_size"), best.alias("__best")))

    marked = flagged(rows)
    single = marked.filter("not __maybe").withColumns({"keep_id": F.col(id_col), "group_size": F.lit(1).cast("long"), "kept": F.lit(True)})
    several = marked.filter("__maybe").join(groups, "text_sha256").withColumn("keep_id", F.col("__best.i"))
    wins = (F.col("__best.p") == -F.col("__points")) & F.col("__best.i").eqNullSafe(F.col(id_col)) & F.col("__best.o").eqNullSafe(F.col(order))
    several = several.withColumn("kept", wins)
    # Rows that are there several times over, id and all, are counted map-side and dealt out again, one of them as kept.
    again = (F.col("kept") & (F.col("__best.n") > 1))
    drop = ("__maybe", "__best", "__points", order)
    once, more = several.filter(~again).drop(*drop), several.filter(again).drop(*[c for c in drop if c != order])
    whole = [c for c in more.columns if c == "row"]  # its hash is ``order``
    more = more.groupBy(*[c for c in more.columns if c not in whole]).agg(*[F.first(c).alias(c) for c in whole], F.count("*").alias("__n")).drop(order)
    more = more.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / BLOCK)))).repartition("text_sha256", "__block")
    more = more.withColumn("__i", F.explode(F.sequence(F.col("__block") * BLOCK, F.least(F.col("__n"), (F.col("__block") + 1) * BLOCK) - 1))).withColumn("kept", F.col("__i") == 0)
    return single.drop(*drop).unionByName(once).unionByName(more.drop("__n", "__block", "__i"))


def exact_dedup(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Every row of ``docs`` with keep_id, group_size, kept and text_sha256.

    Of equal texts the row with the most code points, then the smallest id stays; null ids come last,
    and of rows equal (maps: as JSON) in every column one stays. Null text counts as empty, empty texts are equal.
    An empty table gives an empty result. Columns of the added names are replaced.
    """
    docs = without(docs, *ADDED)
    # The row as it is travels in one column, so that its names meet none of ours.
    packed = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(text).alias("text"))
    rows = keyed(packed).withColumn("__tie", row_hash(packed, "row")).drop("text")
    narrow = cut(rows.select("id", "text_sha256", "__points", "__tie"))
    return resolve(rows, narrow, "id").select("row.*", *ADDED)


def deduplicated(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, with the columns of ``docs``."""
    return exact_dedup(docs, text, id_col).filter("kept").select(docs.columns)


def digest(docs: DataFrame) -> DataFrame:
    """One row per document, dropped ones too: doc_id, keep_id, group_size, kept, text_sha256."""
    narrow = cut(keyed(docs.select("doc_id", "text")).select("doc_id", "text_sha256", "__points", F.lit(0).alias("__tie")))
    return resolve(narrow, narrow).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS s,
         length(coalesce(text, '')) AS p
  FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY p DESC, doc_id) AS k FROM n)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY s ORDER BY k) AS keep_id,
       count(*) OVER (PARTITION BY s) AS group_size, k = 1 AS kept, s AS text_sha256
FROM r
"""

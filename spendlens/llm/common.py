"""What several training-data operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.operators.durable import cut, shared_dir  # noqa: F401  used by the operators here

#: ASCII white space of the contracts: blank, and tab to carriage return.
WHITE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with the session's Arrow batches held to BATCH_ROWS rows: a batch of whole texts must fit a worker's memory however long they are."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back, so that each reader reads only its columns and a lost executor loses none of it."""
    folder = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns that an operator is about to add."""
    return df.drop(*names)


def row_hash(df: DataFrame, row: str, *more: str) -> Column:
    """A 128-bit hash of a row that stands in one struct column (and of more columns), as a struct of two numbers.

    Maps have no hash in Spark, so a row with a map or a variant in it is hashed as JSON.
    """
    unhashed = any(kind in df.schema[row].dataType.simpleString() for kind in ("map<", "variant"))
    values = [F.to_json(row, {"ignoreNullFields": "false"}) if unhashed else F.col(row), *[F.col(c) for c in more]]
    return F.struct(F.xxhash64(*values).alias("a"), F.xxhash64(F.lit(1), *values).alias("b"))


def text_of(name: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


#: Rows of a key filter: 16 bytes each, so that its broadcast has a bound.
FILTER_WORDS = 1 << 20


class KeyFilter:
    """A blocked Bloom filter of 64-bit keys as a table of at most FILTER_WORDS words; what misses it is surely no key."""

    def __init__(self, keys: DataFrame, key: str, n: int):
        self.words = 1 << max(4, min((FILTER_WORDS - 1).bit_length(), (max(1, n) // 4).bit_length()))
        cells = keys.select(self._word(key).alias("__w"), self._mask(key).alias("__m"))
        self.table = F.broadcast(cells.groupBy("__w").agg(F.expr("bit_or(__m)").alias("__b")))

    def _word(self, key: str) -> Column:
        return F.expr(f"{key} & {self.words - 1}L")

    @staticmethod
    def _mask(key: str) -> Column:
        return F.expr(" | ".join(f"shiftleft(1L, cast(shiftrightunsigned({key}, {n}) & 63 as int))" for n in (40, 47, 54)))

    def flag(self, df: DataFrame, key: str, name: str) -> DataFrame:
        """``df`` with a boolean column: whether the key may be among the filter's."""
        marked = df.withColumn("__w", self._word(key)).join(self.table, "__w", "left")
        return marked.withColumn(name, F.col("__b").isNotNull() & ((F.col("__b").bitwiseAND(self._mask(key))) == self._mask(key))).drop("__w", "__b")

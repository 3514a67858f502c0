"""Monthly files as a stream: each decision is taken once, the first time it comes, and month totals follow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Months of a batch up to which they are broadcast, so that only their partitions are read.
MOST_MONTHS = 10_000
DECISIONS = "ada string, org string, issue_date timestamp, amount double, supplier_key string"


def read_new_files(spark: SparkSession, folder: str, schema: str = DECISIONS, files_a_batch: int = 100) -> DataFrame:
    """Decisions of Parquet files as they arrive below a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def first_rows(stream: DataFrame, late: str = "31 days") -> DataFrame:
    """Rows whose id has not come before; an id is remembered for as long as rows may come late."""
    return stream.withWatermark("issue_date", late).dropDuplicatesWithinWatermark(["ada"])


def month_totals(stream: DataFrame, late: str = "31 days") -> DataFrame:
    """(org, window, decisions, amount) of 30-day windows, each final once its watermark has passed."""
    w = stream.withWatermark("issue_date", late).groupBy("org", F.window("issue_date", "30 days"))
    return w.agg(F.count("*").alias("decisions"), F.sum("amount").alias("amount"))


def start(df: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """The stream written as Parquet, exactly once; ends when all that is there is done."""
    return df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").option("path", path).start()


def merge_months(stream: DataFrame, path: str, checkpoint: str, key: str = "ada", by: tuple[str, ...] = ("year", "month")):
    """The stream merged into a Parquet table partitioned ``by`` month: rows whose key the month has not, each once; what is there stays.

    However late a month is fetched again, what it lacks is added: every batch is compared with the months that it brings, and only with
    those. Of several rows of a batch with one key the least in all columns stays; rows without a key all stay. A batch that is repeated adds
    nothing. Ends when all that is there is done.
    """

    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.filter(F.col(key).isNotNull())
        new = new.groupBy(*by, key).agg(F.min(F.struct(*[c for c in batch.columns if c not in (*by, key)])).alias("row")).select(*by, key, "row.*")
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
            months = F.broadcast(new.select(*by).distinct().limit(MOST_MONTHS)) if new.select(*by).distinct().count() <= MOST_MONTHS else new.select(*by).distinct()
            there = spark.read.schema(batch.schema).parquet(path).join(months, list(by), "left_semi").select(*by, key)
            new = new.join(there, [*by, key], "left_anti")
        keyless = batch.filter(F.col(key).isNull())
        new.unionByName(keyless).repartition(*by).write.mode("append").partitionBy(*by).parquet(path)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

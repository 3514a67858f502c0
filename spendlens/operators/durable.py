"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own where that is unset and all runs on one machine, as in tests. On a cluster it must be set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (found or tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp")).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder: a lost executor loses none of it."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read back: smaller than ``cut``, and later steps read only the columns that they need."""
    path = f"{shared_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt out by keys to all cores: for rows that are much work each, since a small file, however many rows it has, is one task."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)

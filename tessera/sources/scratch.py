"""Tables between the rounds of an iteration, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def root(spark: SparkSession) -> str:
    """The folder that all executors share; a private one where none is named and the master is local."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:  # tests and laptops
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = _local.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="tessera-"))
    return named.rstrip("/")


def parts(spark: SparkSession) -> int:
    """Partitions of a shuffle, for rows that must not be put together by their compressed size."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def cut(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write df as a table and read it again: plans stay short, and a lost executor costs its tasks only.  by: a column of few values that makes a folder each."""
    spark = df.sparkSession
    path = f"{root(spark)}/rounds/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)

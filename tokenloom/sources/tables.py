"""Parquet tables, read so that every core has work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Tables above this size, by Spark's own estimate, are never shuffled for the sake of more tasks.
SPREAD_BYTES = 1 << 30


def size_in_bytes(df: DataFrame) -> int:
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def spread(df: DataFrame) -> DataFrame:
    """A small table in fewer pieces than there are cores, dealt out evenly; any other as it is.

    A row group is not split, so one small file is one task.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores and size_in_bytes(df) <= SPREAD_BYTES:
        return df.repartition(cores)
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))

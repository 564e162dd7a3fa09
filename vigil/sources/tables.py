"""Table scans.

Parquet scans keep Spark's split planning (``files.maxPartitionBytes``), so
at scale a table arrives in as many partitions as it has splits.  The CPU
heavy per-row operators here (regex scans, rule expressions) need at least
several partitions.  A table that arrives as one single split, which bounds
its size by ``spark.sql.files.maxPartitionBytes`` (a small table stored as one
row group), is spread with a round-robin repartition; any other stays as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def ensure_parallel(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    spark = df.sparkSession
    target = min_partitions or spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() == 1 < target:
        return df.repartition(target)
    return df


def read_table(spark: SparkSession, sf_dir: str, name: str, parallel: bool = False) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return ensure_parallel(df) if parallel else df

"""Numbered sub-folders, on whatever file system their folder lies."""

from __future__ import annotations

from pyspark.sql import SparkSession


def file_system(spark: SparkSession, folder: str):
    """The Hadoop file system of ``folder`` and its path there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def versions(spark: SparkSession, folder: str, kind: str, mark: str = "_SUCCESS") -> list[int]:
    """The numbers n, ascending, of the sub-folders ``kind=n`` that hold the file ``mark``, so were written to the end."""
    fs, path = file_system(spark, folder)
    names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{kind}=") and fs.exists(path.suffix(f"/{n}/{mark}")))

"""Whole tables in order, and pages of them.

``ordered`` numbers all rows of a table in a total order, without one task that holds
them.  ``write_pages`` stores them as one file per page with an index of the pages, so
that a page is read from its file and nothing is sorted again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions.ordered import running_totals

PAGE_ROWS = 10_000


def newest_first(time: str, key: str) -> Column:
    """Order by falling time, then by key; rows without a time come last."""
    return F.struct(F.col(time).isNull().alias("none"), (-F.unix_micros(F.col(time).cast("timestamp"))).alias("t"), F.col(key).alias("k"))


def ordered(df: DataFrame, order: Column, number: str = "nth") -> DataFrame:
    """``df`` with the rows' numbers from 1."""
    rows = running_totals(df.withColumn("_order", order), "_order", [], index_col="_idx")
    return rows.withColumn(number, F.col("_idx") + 1).drop("_order", "_idx")


def write_pages(numbered: DataFrame, path: str, page_rows: int = PAGE_ROWS, number: str = "nth") -> None:
    """One file a page under ``path/pages``; ``path/index`` holds each page's
    first and last number.  Rows meet by page, so no task sorts more than its pages."""
    paged = numbered.withColumn("page", F.floor((F.col(number) - 1) / page_rows).cast("long"))
    spark = numbered.sparkSession
    (paged.repartition(F.col("page")).sortWithinPartitions("page", number).write.partitionBy("page").mode("overwrite").parquet(f"{path}/pages"))
    (spark.read.parquet(f"{path}/pages").groupBy("page").agg(F.min(number).alias("first"), F.max(number).alias("last"), F.count(F.lit(1)).alias("n"))
     .write.mode("overwrite").parquet(f"{path}/index"))


def read_page(spark: SparkSession, path: str, page: int) -> DataFrame:
    """The rows of a page (from 0), in order; no other file is read."""
    return spark.read.parquet(f"{path}/pages").where(F.col("page") == page).drop("page").orderBy("nth")


def read_rows(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """Rows number ``first`` to ``last``: the index names the pages, a file each."""
    pages = [r["page"] for r in spark.read.parquet(f"{path}/index").where((F.col("last") >= first) & (F.col("first") <= last)).select("page").collect()]  # the pages asked for
    return spark.read.parquet(f"{path}/pages").where(F.col("page").isin(pages) & F.col("nth").between(first, last)).drop("page").orderBy("nth")

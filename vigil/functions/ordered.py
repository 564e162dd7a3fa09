"""Global order statistics without a single-partition window.

``running_totals`` gives every row its 0-based position in a global order
and running sums of value columns: rows are range-partitioned by the order
key, each partition is summed, partition offsets come from a table with one
row per partition, and the rest is computed inside each partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_totals(df: DataFrame, order_col: str, value_cols: list[str], partitions: int | None = None,
                   index_col: str = "idx", by: list[str] | None = None) -> DataFrame:
    """Adds ``index_col`` (0-based position by ``order_col``, unique within
    each ``by`` group; global when ``by`` is empty) and ``cum_<c>`` running
    sums for each value column.  The offsets table has one row per (group,
    partition) the group touches, so a large group is still split across
    partitions."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = by or []
    from vigil.session import materialize
    # written once: both the partition sums and the local pass read it, and
    # the upstream plan (often an expensive aggregate) must not run twice
    p = materialize(df.repartitionByRange(n, *by, order_col).withColumn("_pid", F.spark_partition_id()))
    part = p.groupBy(*by, "_pid").agg(F.count(F.lit(1)).alias("_rows"), *[F.sum(c).alias(f"_s_{c}") for c in value_cols])
    w_all = Window.partitionBy(*by).orderBy("_pid") if by else Window.orderBy("_pid")
    offs = part.select(*by, "_pid", (F.sum("_rows").over(w_all) - F.col("_rows")).alias("_row_off"),
                       *[(F.sum(f"_s_{c}").over(w_all) - F.col(f"_s_{c}")).alias(f"_o_{c}") for c in value_cols])
    wl = Window.partitionBy("_pid", *by).orderBy(order_col)
    wc = wl.rowsBetween(Window.unboundedPreceding, 0)
    local = p.withColumn("_r", F.row_number().over(wl) - 1)
    for c in value_cols:
        local = local.withColumn(f"_l_{c}", F.sum(c).over(wc))
    j = local.join(offs if by else F.broadcast(offs), [*by, "_pid"])
    out = j.withColumn(index_col, F.col("_row_off") + F.col("_r"))
    for c in value_cols:
        out = out.withColumn(f"cum_{c}", F.col(f"_o_{c}") + F.col(f"_l_{c}"))
    return out.drop("_pid", "_r", "_row_off", *[f"_l_{c}" for c in value_cols], *[f"_o_{c}" for c in value_cols])

"""Address-in-range lookups for feeds of any size.

Small, fixed range lists are inlined into the expression (see
``verify.range_array``).  For data-sized feeds every CIDR is keyed by the one
block that contains it — its /16 when the prefix is 16 or longer, its /8
when 8..15, a single shared key otherwise — and each address probes its three
candidate keys.  That turns the range join into an equi-join (no nested
loop), with a ``between`` filter and a first-match ``min_by`` per address.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.functions.net import ip_to_long


def keyed_ranges(ranges: DataFrame, cidr_col: str = "cidr") -> DataFrame:
    """ranges(ord, cidr, ...) → + lo, hi, level, bkey."""
    parts = F.split(F.col(cidr_col), "/")
    base = ip_to_long(F.get(parts, 0))
    bits = F.coalesce(F.get(parts, 1).cast("int"), F.lit(32))
    level = F.when(bits >= 16, 16).when(bits >= 8, 8).otherwise(0)
    return (ranges.withColumn("_base", base).withColumn("_bits", bits)
            .withColumn("_size", F.expr("shiftleft(CAST(1 AS BIGINT), 32 - _bits)"))
            .withColumn("lo", F.col("_base") - F.pmod(F.col("_base"), F.col("_size")))
            .withColumn("hi", F.col("lo") + F.col("_size") - 1).withColumn("level", level)
            .withColumn("bkey", F.expr("CASE WHEN level = 0 THEN CAST(0 AS BIGINT) ELSE shiftright(lo, 32 - level) END"))
            .drop("_base", "_bits", "_size"))


def range_hits(addrs: DataFrame, ranges: DataFrame, ip_col: str = "ip", keys: list[str] | None = None,
               order_col: str = "ord") -> DataFrame:
    """First range (by ``order_col``) containing each address row.

    addrs(keys..., ip) → keys..., ip, cidr, plus all range columns of the hit.
    Addresses without a hit are not returned (inner semantics)."""
    keys = keys or []
    kr = keyed_ranges(ranges)
    a = addrs.withColumn("_ipl", ip_to_long(F.col(ip_col))).where(F.col("_ipl").isNotNull())
    probes = a.withColumn("_probe", F.explode(F.array(
        F.struct(F.lit(16).alias("level"), F.shiftright("_ipl", 16).alias("bkey")),
        F.struct(F.lit(8).alias("level"), F.shiftright("_ipl", 24).alias("bkey")),
        F.struct(F.lit(0).alias("level"), F.lit(0).cast("bigint").alias("bkey")))))
    probes = probes.select("*", F.col("_probe.level").alias("level"), F.col("_probe.bkey").alias("bkey")).drop("_probe")
    j = probes.join(kr, ["level", "bkey"]).where((F.col("_ipl") >= F.col("lo")) & (F.col("_ipl") <= F.col("hi")))
    range_cols = [c for c in ranges.columns]
    best = j.groupBy(*keys, ip_col).agg(F.min_by(F.struct(*range_cols), F.col(order_col)).alias("_hit"))
    return best.select(*keys, ip_col, *[F.col(f"_hit.{c}").alias(c) for c in range_cols])

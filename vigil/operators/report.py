"""Dashboard aggregates over scored alerts.

Totals and tier counts are partial/final aggregates (map-side combine, one
row per group shuffled).  Top-k feeds use ``orderBy(...).limit(k)``, which
Spark plans as a per-partition top-k followed by a k-row merge, so no task
ever holds more than k rows per partition.  Tick windows aggregate first and
only then apply the (small) tick-ordered window functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.sources import dims

SEVERITIES = [n for n, _ in dims.SEVERITY_TIERS]


def totals(df: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return df.agg(n.alias("total_alerts"),
                  F.count(F.when(F.col("decoy_hit"), 1)).alias("honeypots_triggered"),
                  F.count(F.when(F.col("verification_status") == "VERIFIED", 1)).alias("n_verified"),
                  F.count(F.when(F.col("verification_status") == "FALSE_POSITIVE", 1)).alias("n_false_positive"),
                  F.sum("confidence_score").cast("bigint").alias("sum_confidence_score"),
                  (F.sum("confidence_score") / F.greatest(n, F.lit(1))).alias("mean_confidence_score"))


def newest_first(df: DataFrame):
    return [F.col("timestamp").desc(), F.col("alert_id").desc()]


def newest(df: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` rows (per-partition top-n, then a merge of n rows each)."""
    return df.orderBy(*newest_first(df)).limit(n)


def false_positive_rate(df: DataFrame, n: int = 50) -> DataFrame:
    """Share of FALSE_POSITIVE among the newest ``n`` alerts (3 dp).

    Given unscored alerts through ``newest`` first, only ``n`` rows are scored."""
    last = df.select("timestamp", "alert_id", "verification_status").orderBy(*newest_first(df)).limit(n)
    cnt = F.count(F.lit(1))
    fp = F.count(F.when(F.col("verification_status") == "FALSE_POSITIVE", 1))
    return last.agg(cnt.alias("n_recent"), fp.alias("n_false_positive"),
                    F.round(fp / F.greatest(cnt, F.lit(1)), 3).alias("false_positive_rate"))


def recent(df: DataFrame, n: int = 5) -> DataFrame:
    top = df.select("alert_id", "severity", "source_ip", "event_type", "confidence", "timestamp") \
            .orderBy(*newest_first(df)).limit(n)
    w = Window.orderBy(*newest_first(df))
    return top.select("alert_id", "severity", F.coalesce(F.col("source_ip"), F.lit("None")).alias("source_ip"),
                      "event_type", "confidence", F.row_number().over(w).alias("rank"))


def severity_ticks(df: DataFrame, tick: str = "5 seconds", history: int = 60) -> DataFrame:
    """Per tick: counts per tier (= the growth of the cumulative counters
    between two polls), total, highest tier present, cumulative counters,
    and the total over the last ``history`` ticks of the time axis, with or
    without alerts.

    Ticks are aggregated first (partial aggregation); the running totals use
    a distributed global order.  For the ``history`` window, the axis is cut
    into stretches of that many ticks; a tick also counts as history of the next
    stretch, so a window lies in one stretch of at most twice as many rows."""
    from vigil.functions.ordered import running_totals
    counts = [F.count(F.when(F.col("severity") == s, 1)).alias(f"n_{s.lower()}") for s in SEVERITIES]
    t = df.groupBy(F.window("timestamp", tick).start.alias("tick_ts")).agg(*counts, F.count(F.lit(1)).alias("n_total"))
    cols = [f"n_{s.lower()}" for s in SEVERITIES] + ["n_total"]
    r = running_totals(t, "tick_ts", cols)
    step = F.expr(f"unix_micros(timestamp '1970-01-01 00:00:00' + interval {tick})")
    no = F.floor(F.unix_micros("tick_ts") / step)
    here = r.withColumn("_no", no).withColumn("_part", F.floor(F.col("_no") / history)).withColumn("_own", F.lit(True))
    both = here.unionByName(here.withColumn("_part", F.col("_part") + 1).withColumn("_own", F.lit(False)))
    last = Window.partitionBy("_part").orderBy("_no").rangeBetween(-(history - 1), 0)
    r = both.withColumn("_last", F.sum("n_total").over(last)).where("_own")
    maxsev = None
    for s in reversed(SEVERITIES[1:]):
        cond = F.col(f"n_{s.lower()}") > 0
        maxsev = F.when(cond, F.lit(s)) if maxsev is None else maxsev.when(cond, F.lit(s))
    maxsev = maxsev.otherwise(F.lit("BENIGN"))
    return r.select(F.date_format("tick_ts", "yyyy-MM-dd HH:mm:ss").alias("tick"), *cols, maxsev.alias("max_severity"),
                    *[F.col(f"cum_n_{s.lower()}").cast("bigint").alias(f"cum_{s.lower()}") for s in SEVERITIES],
                    F.col("_last").cast("bigint").alias(f"n_last{history}"))


def severity_counts(df: DataFrame) -> DataFrame:
    """Counts per tier, all five tiers present (zero-filled)."""
    spark = df.sparkSession
    c = df.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    return (dims.dim_severity(spark).select("severity", "severity_ord").join(c, "severity", "left")
            .select("severity", "severity_ord", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))


def dominant_severity(df: DataFrame) -> DataFrame:
    """Most frequent tier (first in tier order on ties; BENIGN when empty)."""
    c = severity_counts(df)
    return c.agg(F.when(F.max("n") == 0, F.lit("BENIGN"))
                  .otherwise(F.max_by("severity", F.struct(F.col("n"), -F.col("severity_ord")))).alias("severity"),
                 F.max("n").cast("bigint").alias("n_alerts"))


def alert_feed(df: DataFrame, severities=None, event_type: str | None = None, ip_search: str | None = None,
               limit: int = 500) -> DataFrame:
    """Filtered alert list: decoy hits first, then newest; capped at ``limit``."""
    f = df
    if severities:
        f = f.where(F.col("severity").isin(*severities))
    if event_type and event_type != "All Types":
        f = f.where(F.col("event_type") == event_type)
    if ip_search:
        f = f.where(F.coalesce(F.col("source_ip"), F.lit("")).contains(ip_search)
                    | F.coalesce(F.col("dest_ip"), F.lit("")).contains(ip_search))
    order = [F.col("decoy_hit").desc(), F.col("timestamp").desc(), F.col("alert_id").desc()]
    top = f.select("alert_id", "severity", "event_type", F.coalesce(F.col("source_ip"), F.lit("")).alias("source_ip"),
                   "dest_ip", "decoy_hit", "timestamp").orderBy(*order).limit(limit)
    return top.select("alert_id", "severity", "event_type", "source_ip", "dest_ip", "decoy_hit",
                      F.row_number().over(Window.orderBy(*order)).alias("rank"))


def severity_share(counts: DataFrame) -> DataFrame:
    total = F.sum("n").over(Window.partitionBy())
    return counts.withColumn("share_pct", F.when(total > 0, F.col("n") * 100.0 / total).otherwise(0.0))


def confidence_pct(conf) -> "F.Column":
    return F.round(F.coalesce(conf, F.lit(0.0)) * 100, 1)

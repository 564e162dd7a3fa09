"""Streaming queries: each runs a Structured Streaming job over the events
folder with ``availableNow`` and returns the sink's table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.plans import oracle_sql as O
from vigil.session import apply_session_defaults
from vigil.sources.testviews import AS_OF, alerts_view
from vigil.streaming import alerts_stream as S


def _scored(spark, sf_dir):
    apply_session_defaults(spark)
    return S.scored_stream(spark, sf_dir, AS_OF)


def stream_severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.run_available_now(S.severity_counters(_scored(spark, sf_dir)), "sev", "complete", S.batch_sink)
    return S.latest_per_key(spark, out, ["severity"])


def stream_decoy_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.run_available_now(S.decoy_state(_scored(spark, sf_dir)), "decoy", "update", S.batch_sink)
    r = S.latest_per_key(spark, out, ["asset_id"])
    return r.select("asset_id", "trigger_count", F.date_format("last_triggered", "yyyy-MM-dd HH:mm:ss").alias("last_triggered"))


def stream_tick_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.run_available_now(S.tick_counts(_scored(spark, sf_dir), "1 hour"), "ticks", "update", S.batch_sink)
    r = S.latest_per_key(spark, out, ["tick_ts", "severity"])
    return r.select(F.date_format("tick_ts", "yyyy-MM-dd HH:mm:ss").alias("tick"), "severity", "n_alerts")


def stream_sealed_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.run_available_now(_scored(spark, sf_dir), "seal", "append", S.seal_sink)
    a = spark.read.parquet(out)
    return a.select("snapshot_id", "alert_id", "sha256",
                    (F.sha2(F.col("payload"), 256) == F.col("sha256")).alias("intact"))


def stream_recent_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last-50 buffer kept by a foreachBatch sink, then its false-positive rate."""
    out = S.run_available_now(_scored(spark, sf_dir), "recent", "append", S.recent_buffer_sink(50))
    return S.fp_rate_of_buffer(S.newest_buffer(spark, out))


def stream_repeat_attackers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeat attackers per /16 with keyed streaming state."""
    apply_session_defaults(spark)
    src = alerts_view(S.event_stream(spark, sf_dir))
    out = S.run_available_now(S.repeat_attackers_stream(src), "repeat", "append", S.batch_sink)
    return spark.read.parquet(out).drop("batch_id")


def stream_unique_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed of several files in which every tenth event comes twice, mostly in
    another file: each alert is scored and kept once."""
    from vigil.session import shared_path
    apply_session_defaults(spark)
    feed = shared_path(spark, "feed")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("copy", F.lit(0))
    twice = events.unionByName(events.where("event_id % 10 = 0").withColumn("copy", F.lit(1)))
    twice.repartition(6, "event_id", "copy").drop("copy").write.parquet(feed)
    scored = S.score_alerts(alerts_view(S.event_stream(spark, feed, "*.parquet", 2)), AS_OF)
    out = S.run_available_now(scored, "unique", "append", S.unique_sink("alert_id", ["alert_id", "severity", "verification_status"], 2))
    return spark.read.parquet(out).drop("batch_id")


QUERIES = {
    "stream_unique_alerts": stream_unique_alerts,
    "stream_repeat_attackers": stream_repeat_attackers,
    "stream_recent_buffer": stream_recent_buffer,
    "stream_severity_counts": stream_severity_counts,
    "stream_decoy_state": stream_decoy_state,
    "stream_tick_counts": stream_tick_counts,
    "stream_sealed_archive": stream_sealed_archive,
}

_PAY = O.SEALED_PAYLOAD
def _repeat_oracle() -> str:
    from vigil.plans.q_extra import ORACLE as X
    return X["repeat_attackers"]


ORACLE = {
    "stream_unique_alerts": O.scored_ctes() + "\nSELECT alert_id, severity, verification_status FROM scp",
    "stream_repeat_attackers": _repeat_oracle(),
    "stream_recent_buffer": O.scored_ctes() + """,
l AS (SELECT * FROM scp ORDER BY "timestamp" DESC, alert_id DESC LIMIT 50)
SELECT count(*) AS n_recent, count(CASE WHEN verification_status = 'FALSE_POSITIVE' THEN 1 END) AS n_false_positive,
  round(count(CASE WHEN verification_status = 'FALSE_POSITIVE' THEN 1 END) / greatest(count(*), 1), 3) AS false_positive_rate
FROM l""",
    "stream_severity_counts": O.scored_ctes() + "\nSELECT severity, count(*) AS n_alerts FROM scp GROUP BY 1",
    "stream_decoy_state": O.scored_ctes() + """
SELECT decoy_asset_id AS asset_id, count(*) AS trigger_count, strftime(max("timestamp"), '%Y-%m-%d %H:%M:%S') AS last_triggered
FROM scp WHERE decoy_asset_id IS NOT NULL GROUP BY 1""",
    "stream_tick_counts": O.scored_ctes() + """
SELECT strftime(time_bucket(INTERVAL 1 HOUR, "timestamp"), '%Y-%m-%d %H:%M:%S') AS tick, severity, count(*) AS n_alerts
FROM scp GROUP BY ALL""",
    "stream_sealed_archive": O.scored_ctes() + f"""
SELECT alert_id || '_2024-01-30T12-00-00_' || substr(sha256({_PAY}), 1, 8) AS snapshot_id, alert_id, sha256({_PAY}) AS sha256, true AS intact FROM scp""",
}

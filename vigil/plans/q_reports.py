"""Dashboard reports over scored alerts: totals, rates, top-k, ticks, trends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil.operators import listing as LS
from vigil.operators import report as R
from vigil.plans import oracle_sql as O
from vigil.plans.common import alerts
from vigil.plans.scoring import score_alerts
from vigil.sources import dims
from vigil.sources.testviews import AS_OF


def _scored(spark, sf_dir) -> DataFrame:
    return score_alerts(alerts(spark, sf_dir), AS_OF)


def stats_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.totals(_scored(spark, sf_dir))


def fp_rate_last50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.false_positive_rate(score_alerts(R.newest(alerts(spark, sf_dir), 50), AS_OF), n=50)


def recent_alerts_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.recent(_scored(spark, sf_dir), n=5)


def severity_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.severity_ticks(_scored(spark, sf_dir), "1 hour", history=60)


def dominant_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.dominant_severity(_scored(spark, sf_dir))


def alert_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.alert_feed(_scored(spark, sf_dir), severities=["MEDIUM", "HIGH", "CRITICAL"], event_type=None,
                        ip_search="10.0.0", limit=500)


def alerts_newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All scored alerts in the order of the dashboard's list."""
    s = _scored(spark, sf_dir).select("alert_id", "severity", "verification_status", "confidence_score", "timestamp")
    return LS.ordered(s, LS.newest_first("timestamp", "alert_id")).select("nth", "alert_id", "severity", "verification_status", "confidence_score")


QUERIES = {
    "alerts_newest_first": alerts_newest_first,
    "stats_totals": stats_totals,
    "fp_rate_last50": fp_rate_last50,
    "recent_alerts_top5": recent_alerts_top5,
    "severity_ticks": severity_ticks,
    "dominant_severity": dominant_severity,
    "alert_feed": alert_feed,
}

_S = O.scored_ctes()
_SEVS = [n for n, _ in dims.SEVERITY_TIERS]
_PIVOT = ", ".join(f"count(CASE WHEN severity = '{s}' THEN 1 END) AS n_{s.lower()}" for s in _SEVS)
_MAXSEV = ("CASE " + " ".join(f"WHEN n_{s.lower()} > 0 THEN '{s}'" for s in reversed(_SEVS)) + " ELSE 'BENIGN' END")
_CUMS = ", ".join(f"CAST(sum(n_{s.lower()}) OVER (ORDER BY tick ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum_{s.lower()}"
                  for s in _SEVS)

ORACLE = {
    "alerts_newest_first": O.scored_ctes() + """
SELECT row_number() OVER (ORDER BY "timestamp" DESC, alert_id) AS nth, alert_id, severity, verification_status, confidence_score FROM scp""",
    "stats_totals": _S + """
SELECT count(*) AS total_alerts, count(CASE WHEN decoy_asset_id IS NOT NULL THEN 1 END) AS honeypots_triggered,
  count(CASE WHEN verification_status = 'VERIFIED' THEN 1 END) AS n_verified,
  count(CASE WHEN verification_status = 'FALSE_POSITIVE' THEN 1 END) AS n_false_positive,
  CAST(sum(confidence_score) AS BIGINT) AS sum_confidence_score,
  sum(confidence_score) / greatest(count(*), 1) AS mean_confidence_score
FROM scp""",
    "fp_rate_last50": _S + """,
l AS (SELECT * FROM scp ORDER BY "timestamp" DESC, alert_id DESC LIMIT 50)
SELECT count(*) AS n_recent, count(CASE WHEN verification_status = 'FALSE_POSITIVE' THEN 1 END) AS n_false_positive,
  round(count(CASE WHEN verification_status = 'FALSE_POSITIVE' THEN 1 END) / greatest(count(*), 1), 3) AS false_positive_rate
FROM l""",
    "recent_alerts_top5": _S + """
SELECT alert_id, severity, coalesce(source_ip, 'None') AS source_ip, event_type, confidence,
  CAST(row_number() OVER (ORDER BY "timestamp" DESC, alert_id DESC) AS INTEGER) AS rank
FROM scp ORDER BY "timestamp" DESC, alert_id DESC LIMIT 5""",
    "severity_ticks": _S + f""",
t AS (SELECT time_bucket(INTERVAL 1 HOUR, "timestamp") AS tick, {_PIVOT}, count(*) AS n_total FROM scp GROUP BY 1)
SELECT strftime(tick, '%Y-%m-%d %H:%M:%S') AS tick, {', '.join('n_' + s.lower() for s in _SEVS)}, n_total,
  {_MAXSEV} AS max_severity, {_CUMS},
  CAST(sum(n_total) OVER (ORDER BY tick RANGE BETWEEN INTERVAL 59 HOUR PRECEDING AND CURRENT ROW) AS BIGINT) AS n_last60
FROM t""",
    "dominant_severity": _S + f""",
d AS (SELECT s.severity, s.ord, count(scp.alert_id) AS n
      FROM (VALUES {', '.join(f"('{s}', {i})" for i, s in enumerate(_SEVS))}) AS s(severity, ord)
      LEFT JOIN scp ON scp.severity = s.severity GROUP BY ALL)
SELECT CASE WHEN max(n) = 0 THEN 'BENIGN' ELSE arg_max(severity, n * 10 - ord) END AS severity,
       CAST(max(n) AS BIGINT) AS n_alerts FROM d""",
    "alert_feed": _S + """,
f AS (SELECT * FROM scp WHERE severity IN ('MEDIUM', 'HIGH', 'CRITICAL')
        AND (contains(coalesce(source_ip, ''), '10.0.0') OR contains(coalesce(dest_ip, ''), '10.0.0')))
SELECT alert_id, severity, event_type, coalesce(source_ip, '') AS source_ip, dest_ip, decoy_asset_id IS NOT NULL AS decoy_hit,
  CAST(row_number() OVER (ORDER BY (decoy_asset_id IS NOT NULL) DESC, "timestamp" DESC, alert_id DESC) AS INTEGER) AS rank
FROM f ORDER BY rank LIMIT 500""",
}

"""Source-format queries: logs and feeds are written from the test tables to
the shared folder in their raw formats, then read back through the readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions.ioc import with_ioc_struct, with_iocs
from vigil.operators.iprange import range_hits
from vigil.operators.verify import verify
from vigil.plans import oracle_sql as O
from vigil.plans.common import alerts, table
from vigil.session import shared_path
from vigil.sources import dims
from vigil.sources import logs as L
from vigil.sources.testviews import AS_OF


def _host_log_rows(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    eid = F.col("event_id")
    return e.select(
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias(" timestamp "),
        F.when(eid % 43 == 0, F.lit(None)).otherwise(F.col("user_id")).alias("userId "),
        eid.alias(" eventId"),
        F.element_at(F.array(*[F.lit(p) for p in ["bash", "sshd", "nan", "mimikatz"]]), (eid % 4 + 1).cast("int")).alias("processName"),
        F.when(eid % 37 == 0, F.lit("bad")).when(eid % 41 == 0, F.lit(None))
         .otherwise((F.col("value") / 500.0).cast("string")).alias("sus"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("evil"),
        (eid % 2).alias("_part"))


def hostlog_csv_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_path(spark, "hostlog")
    rows = _host_log_rows(spark, sf_dir)
    for part in (0, 1):
        rows.where(F.col("_part") == part).drop("_part").write.option("header", True).csv(f"{out}/part{part}")
    raw = L.read_csv_logs(spark, [f"{out}/part0", f"{out}/part1", f"{out}/missing"])
    n = L.normalise_host_log(raw, F.lit(AS_OF).cast("timestamp"))
    return n.select("event_type", "source_ip", "severity_raw", "label",
                    F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp"))


def flowlog_csv_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_path(spark, "flowlog")
    a = alerts(spark, sf_dir)
    eid = F.col("event_id")
    rows = a.select(F.col("alert_id").alias("id"), F.col("source_ip").alias("srcip"), F.col("dest_ip").alias("dstip"),
                    F.when(F.col("port") == 0, F.lit("-")).otherwise(F.col("port").cast("string")).alias("dsport"),
                    F.col("protocol").alias("proto"),
                    F.when(eid % 7 == 0, F.lit("")).otherwise(F.col("event_type")).alias("attack_cat"),
                    F.col("label").alias("Label"))
    rows.write.option("header", True).csv(out)
    raw = L.read_csv_logs(spark, [out])
    n = L.normalise_flow_log(raw, F.lit(AS_OF).cast("timestamp"))
    # port as text: a missing port stays a null string rather than a NaN
    return n.withColumn("port", F.col("port").cast("string"))


def _written_feed(spark: SparkSession) -> dict[str, DataFrame]:
    import json
    path = shared_path(spark, "ti-feed")
    kb = {"bad_ips": dims.TI_BAD_IPS, "bad_cves": dims.TI_BAD_CVES, "bad_processes": dims.TI_BAD_PROCESSES}
    spark.createDataFrame([(json.dumps(kb, indent=4),)], "value string").coalesce(1).write.text(path)
    return L.read_ti_feed(spark, path)


def ti_feed_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipped feed as JSON → bucketed range join with every address occurrence."""
    feed = _written_feed(spark)
    a = with_ioc_struct(alerts(spark, sf_dir), "raw_log", "processName", out="ioc")
    src = F.when(F.col("source_ip").isNotNull() & (F.col("source_ip") != ""), F.array("source_ip")) \
           .otherwise(F.array().cast("array<string>"))
    addrs = a.select("alert_id", F.posexplode_outer(F.concat(F.col("ioc")["ipv4"], src)).alias("pos", "ip")) \
             .where(F.col("ip").isNotNull())
    hits = range_hits(addrs, feed["ti_cidr"], "ip", keys=["alert_id", "pos"])
    return hits.groupBy("alert_id").agg(F.count(F.lit(1)).alias("n_ti_hits"))


def verify_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verification against a feed that was read from JSON: every lookup is a join by key."""
    feed = _written_feed(spark)
    a = with_iocs(alerts(spark, sf_dir), "raw_log", "processName")
    return verify(a, AS_OF, feed=feed).select("alert_id", "c3", "confidence_score", "verification_status")


def written_requests(spark: SparkSession, sf_dir: str) -> str:
    """Every alert as a request in JSON lines, some broken or invalid; returns their folder."""
    path = shared_path(spark, "requests")
    a = alerts(spark, sf_dir)
    eid = F.col("event_id")
    body = F.to_json(F.struct(
        "raw_log", F.coalesce("source_ip", F.lit("not_an_ip")).alias("source_ip"), "dest_ip",
        F.when(eid % 71 == 0, F.lit(99999)).otherwise(F.col("port")).alias("port"),
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), "event_type", "accessed_path", "protocol"))
    line = F.when(eid % 113 == 0, F.concat(F.lit("{broken json "), F.col("alert_id"))).otherwise(body)
    a.select(line.alias("value")).write.text(path)
    return path


def request_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok, bad = L.read_requests(spark, written_requests(spark, sf_dir))
    return (ok.select(F.lit("accepted").alias("outcome")).unionByName(bad.select(F.col("reject_reason").alias("outcome")))
              .groupBy("outcome").agg(F.count(F.lit(1)).alias("n")))


def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.column_profile(table(spark, sf_dir, "events").drop("ts"))


QUERIES = {
    "hostlog_csv_ingest": hostlog_csv_ingest,
    "flowlog_csv_ingest": flowlog_csv_ingest,
    "ti_feed_hits": ti_feed_hits,
    "verify_feed": verify_feed,
    "request_validation": request_validation,
    "column_profile": column_profile,
}

ORACLE = {
    "hostlog_csv_ingest": """
SELECT CAST(event_id AS VARCHAR) AS event_type,
  CASE WHEN event_id % 43 = 0 THEN NULL ELSE CAST(user_id AS VARCHAR) END AS source_ip,
  CASE WHEN event_id % 37 = 0 OR event_id % 41 = 0 THEN 0.0 ELSE value / 500.0 END AS severity_raw,
  CAST(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS INTEGER) AS label,
  strftime(ts, '%Y-%m-%d %H:%M:%S') AS "timestamp"
FROM events""",
    "flowlog_csv_ingest": "WITH " + O.ALERTS_V_SQL.strip() + """
SELECT nullif(source_ip, '') AS source_ip, dest_ip, CASE WHEN port = 0 THEN NULL ELSE CAST(port AS VARCHAR) END AS port, protocol,
  CASE WHEN event_id % 7 = 0 THEN 'normal' ELSE event_type END AS event_type, label,
  TIMESTAMP '2024-01-30 12:00:00' AS "timestamp",
  replace('{~id~: ~' || alert_id || '~, ~srcip~: ' || coalesce('~' || nullif(source_ip, '') || '~', 'nan') || ', ~dstip~: ' || coalesce('~' || dest_ip || '~', 'nan')
  || ', ~dsport~: ' || CASE WHEN port = 0 THEN '~-~' ELSE CAST(port AS VARCHAR) END || ', ~proto~: ' || coalesce('~' || protocol || '~', 'nan')
  || ', ~attack_cat~: ' || CASE WHEN event_id % 7 = 0 THEN 'nan' ELSE '~' || event_type || '~' END || ', ~Label~: ' || CAST(label AS VARCHAR) || '}', '~', chr(39)) AS raw_log
FROM alerts_v""",
    "ti_feed_hits": O.alerts_verified_ctes() + "\nSELECT alert_id, n_ti AS n_ti_hits FROM vs WHERE n_ti > 0",
    "verify_feed": O.scored_ctes() + "\nSELECT alert_id, CAST(c3 AS INTEGER) AS c3, confidence_score, verification_status FROM scp",
    "request_validation": "WITH " + O.ALERTS_V_SQL.strip() + """,
r AS (SELECT CASE WHEN event_id % 113 = 0 THEN 'unparsable'
                  WHEN NOT regexp_full_match(coalesce(source_ip, 'not_an_ip'), '^\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}$')
                    OR NOT regexp_full_match(dest_ip, '^\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}$') THEN 'invalid IPv4 address'
                  WHEN event_id % 71 = 0 THEN 'port out of range'
                  ELSE 'accepted' END AS outcome FROM alerts_v)
SELECT outcome, count(*) AS n FROM r GROUP BY 1""",
    "column_profile": """
SELECT 'event_id' AS column_name, 'bigint' AS dtype, count(event_id) AS non_null, CAST(min(event_id) AS VARCHAR) AS min_value FROM events
UNION ALL SELECT 'user_id', 'bigint', count(user_id), CAST(min(user_id) AS VARCHAR) FROM events
UNION ALL SELECT 'event_type', 'string', count(event_type), min(event_type) FROM events
UNION ALL SELECT 'value', 'double', count(value), CAST(min(value) AS VARCHAR) FROM events
UNION ALL SELECT 'props', 'string', count(props), min(props) FROM events""",
}

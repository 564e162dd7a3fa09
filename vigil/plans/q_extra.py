"""Dashboard cards, repeat attackers, CACAO export / scan and training export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions.ioc import with_iocs
from vigil.operators import cards as C
from vigil.operators import listing as LS
from vigil.operators import triage as TR
from vigil.plans import oracle_sql as O
from vigil.plans.common import alerts
from vigil.plans.q_sources import _host_log_rows
from vigil.plans.scoring import score_alerts
from vigil.session import shared_path
from vigil.sources import logs as L
from vigil.sources.testviews import AS_OF

CACAO_SCHEMA = ("type string, spec_version string, id string, name string, description string, created string, "
                "modified string, created_by string, playbook_types array<string>, workflow_start string, "
                "workflow map<string, struct<type:string, name:string, description:string, executed_at:string, on_completion:string>>")


def alert_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = C.card_fields(score_alerts(alerts(spark, sf_dir), AS_OF))
    tags = F.col("evidence_tags")
    n_tag = lambda t: F.size(F.filter(tags, lambda e: e["tag"] == t))
    n_pass = lambda p: F.size(F.filter(tags, lambda e: e["pass"] == p))
    return c.select("alert_id", "title", "status_label",
                    F.array_join(F.transform("steps", lambda s: s["status"]), ",").alias("step_status"),
                    "attacker_host", "target_account", "payload_ref", "confidence_pct", "gauge_band",
                    n_tag("threat").alias("n_threat"), n_tag("warn").alias("n_warn"), n_tag("ok").alias("n_ok"),
                    n_pass("1").alias("n_pass1"), n_pass("2").alias("n_pass2"), n_pass("3").alias("n_pass3"))


def repeat_attackers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.repeat_attackers(alerts(spark, sf_dir))


def cacao_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Export one CACAO document per incident (JSON lines), scan them back
    with an explicit schema (unparsable lines dropped) and build history rows."""
    path = shared_path(spark, "cacao")
    s = score_alerts(alerts(spark, sf_dir), AS_OF)
    docs = s.select(F.to_json(TR.cacao_document(F.col("alert_id"), F.col("playbook_actions"), F.col("summary"),
                                                F.col("captured_at"))).alias("value"))
    docs.write.text(path)
    scan = spark.read.schema(CACAO_SCHEMA).json(path).where(F.col("workflow").isNotNull())
    steps = F.map_values("workflow")
    actions = F.filter(steps, lambda w: w["type"] == "action")
    n = F.size(actions)
    return scan.select(
        F.concat(F.lit("pb_"), F.regexp_extract("name", r"Incident (\S+)$", 1)).alias("playbook_id"),
        F.regexp_extract("name", r"Incident (\S+)$", 1).alias("alert_id"),
        F.lit("RESOLVED").alias("outcome"), n.alias("n_action_steps"), (n * 2).alias("duration_s"),
        F.coalesce(F.substring("created", 1, 19), F.lit("")).alias("started_at"),
        F.lit("UNKNOWN").alias("severity"),
        F.array_join(F.transform(actions, lambda w, i: F.concat_ws(" ", (i * 2).cast("string"), w["name"])), "; ").alias("timeline"))


def cacao_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exported documents of which some lines broke and some lost their workflow:
    the rest as history in order of its start, newest first, and what was set aside."""
    path, aside = shared_path(spark, "cacao-broken"), shared_path(spark, "cacao-quarantine")
    s = score_alerts(alerts(spark, sf_dir), AS_OF)
    eid = F.col("event_id")
    text = F.to_json(TR.cacao_document(F.col("alert_id"), F.col("playbook_actions"), F.col("summary"), F.col("timestamp")))
    line = F.when(eid % 59 == 0, F.concat(F.lit("{"), text)).when(eid % 47 == 0, F.concat(F.lit('{"name": "Incident '), F.col("alert_id"), F.lit('"}'))).otherwise(text)
    s.select(line.alias("value")).write.text(path)
    kept = L.read_or_quarantine(spark, path, CACAO_SCHEMA, F.col("workflow").isNotNull(), aside)
    history = kept.select(F.regexp_extract("name", r"Incident (\S+)$", 1).alias("alert_id"), F.substring("created", 1, 19).alias("started_at"))
    history = LS.ordered(history, LS.newest_first("started_at", "alert_id")).select(F.lit("kept").alias("outcome"), "nth", "alert_id", "started_at")
    away = spark.read.parquet(aside).groupBy(F.col("reason").alias("outcome")).agg(F.count(F.lit(1)).alias("nth"))
    return history.unionByName(away.withColumn("alert_id", F.lit(None).cast("string")).withColumn("started_at", F.lit(None).cast("string")))


def request_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alert requests as JSON lines: valid ones become alerts and are scored."""
    from vigil.plans.q_sources import written_requests
    ok, _ = L.read_requests(spark, written_requests(spark, sf_dir))
    a = L.alerts_of_requests(ok, F.lit(AS_OF).cast("timestamp")).withColumn("processName", F.lit(None).cast("string"))
    s = score_alerts(a, AS_OF)
    return s.select("alert_id", "event_type", "confidence_score", "verification_status", "severity", "confidence", "playbook_state",
                    F.size("evidence").alias("n_evidence"))


def evidence_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of evidence of every alert in its order, with what its text lists in brackets."""
    from vigil.plans.common import verified_alerts
    v = verified_alerts(spark, sf_dir).select("alert_id", F.posexplode_outer("evidence").alias("pos", "e"))
    return v.select("alert_id", (F.col("pos") + 1).alias("position"), F.col("e.pass").alias("pass"), "e.rule", "e.weight", "e.subject",
                    F.regexp_extract("e.text", r"\[([^\]]*)\]", 1).alias("listed"))


def training_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host-log CSV → normalised alerts → indicators (+ process column) →
    CSV export with the indicator map as JSON → label / indicator counts."""
    src = shared_path(spark, "train-src")
    _host_log_rows(spark, sf_dir).drop("_part").write.option("header", True).csv(src)
    n = L.normalise_host_log(L.read_csv_logs(spark, [src]), F.lit(AS_OF).cast("timestamp"))
    x = with_iocs(n, "raw_log", "processName")
    out = shared_path(spark, "train-export")
    (x.select("timestamp", "source_ip", "event_type", "raw_log", F.to_json("iocs").alias("iocs"), "severity_raw",
              "label", "processName").write.option("header", True).csv(out))
    back = spark.read.option("header", True).csv(out)
    return (back.groupBy(F.col("label").cast("int").alias("label"))
                .agg(F.count(F.lit(1)).alias("n_rows"),
                     F.count(F.when(F.col("iocs") != "{}", 1)).alias("n_with_ioc")))


QUERIES = {
    "cacao_quarantine": cacao_quarantine,
    "request_scores": request_scores,
    "evidence_long": evidence_long,
    "alert_cards": alert_cards,
    "repeat_attackers": repeat_attackers,
    "cacao_history": cacao_history,
    "training_export": training_export,
}

_ALERTS = O.ALERTS_V_SQL.strip()
_VALID_IP = r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"
# the accepted requests in place of the alerts
_REQUESTED = "WITH " + _ALERTS.replace("alerts_v AS (", "alerts_given AS (", 1) + f""",
alerts_v AS (SELECT * REPLACE (
    'REQ-' || md5(concat_ws('|', raw_log, source_ip, dest_ip, CAST(port AS VARCHAR), strftime("timestamp", '%Y-%m-%dT%H:%M:%SZ'), event_type)) AS alert_id,
    date_trunc('second', "timestamp") AS "timestamp", NULL::VARCHAR AS "processName")
  FROM alerts_given WHERE event_id % 113 <> 0 AND event_id % 71 <> 0
    AND regexp_full_match(source_ip, '{_VALID_IP}') AND regexp_full_match(dest_ip, '{_VALID_IP}'))"""
# rules in order within a pass; entries within a rule in order of their place
_EVIDENCE = O.alerts_verified_ctes() + f""",
flags AS (SELECT *, event_type IN ({', '.join(O.q(e) for e in O.EVENT_NAMES)}) AS known FROM vs),
ev AS (
  SELECT alert_id, 1 AS pass, 1 AS o, 0 AS i, CASE WHEN len(gaps) = 0 THEN 'structure_ok' ELSE 'structure_gap' END AS rule, c1 AS weight,
    CASE WHEN len(gaps) = 0 THEN event_type ELSE array_to_string(gaps, ', ') END AS subject, array_to_string(gaps, ', ') AS listed FROM flags
  UNION ALL SELECT alert_id, 2, 1, 0, 'event_known', 10, event_type, '' FROM flags WHERE known
  UNION ALL SELECT alert_id, 2, 2, 0, 'ingress_service', 30, CAST(port AS VARCHAR), '' FROM flags WHERE f_ingress = 1
  UNION ALL SELECT alert_id, 2, 3, 0, 'east_west', 20, CAST(port AS VARCHAR), '' FROM flags WHERE f_eastwest = 1
  UNION ALL SELECT alert_id, 2, 4, 0, 'lateral_ips', 15, array_to_string(k_lateral, ','),
    array_to_string(k_lateral[1:4], ', ') || CASE WHEN len(k_lateral) > 4 THEN ' +' || (len(k_lateral) - 4) || ' more' ELSE '' END FROM flags WHERE len(k_lateral) > 0
  UNION ALL SELECT alert_id, 2, 5, 0, 'external_ips', 10, array_to_string(k_ipv4, ','),
    array_to_string(k_ipv4[1:3], ', ') || CASE WHEN len(k_ipv4) > 3 THEN ' +' || (len(k_ipv4) - 3) || ' more' ELSE '' END FROM flags WHERE len(k_ipv4) > 0
  UNION ALL SELECT alert_id, 2, 6, 0, 'domains', 10, array_to_string(k_domain, ','),
    array_to_string(k_domain[1:3], ', ') || CASE WHEN len(k_domain) > 3 THEN ' +' || (len(k_domain) - 3) || ' more' ELSE '' END FROM flags WHERE len(k_domain) > 0
  UNION ALL SELECT alert_id, 2, 7, 0, 'no_anomaly', 0, event_type, '' FROM flags WHERE c2 = 0
  UNION ALL SELECT alert_id, 3, 1, pos, 'ti_ip', 30, ip, '' FROM tih
  UNION ALL SELECT alert_id, 3, 2, pos, 'risk_range', 20, ip, '' FROM rk_counted
  UNION ALL SELECT alert_id, 3, 3, i, 'ti_cve', 30, k_cve[i], '' FROM (SELECT alert_id, k_cve, generate_subscripts(k_cve, 1) AS i FROM flags WHERE len(k_cve) > 0)
    WHERE upper(k_cve[i]) IN ({', '.join(O.q(c.upper()) for c in O.dims.TI_BAD_CVES)})
  UNION ALL SELECT alert_id, 3, 4, i, 'ti_process', 30, k_process[i], '' FROM (SELECT alert_id, k_process, generate_subscripts(k_process, 1) AS i FROM flags WHERE len(k_process) > 0)
    WHERE lower(k_process[i]) IN ({', '.join(O.q(c.lower()) for c in O.dims.TI_BAD_PROCESSES)})
  UNION ALL SELECT alert_id, 3, 5, 0, 'sha256', 10, array_to_string(k_sha256[1:2], ', '), array_to_string(k_sha256[1:2], ', ') || '...' FROM flags WHERE len(k_sha256) > 0
  UNION ALL SELECT alert_id, 3, 6, 0, 'no_intel', 0, event_type, '' FROM flags WHERE c3 = 0)
SELECT alert_id, CAST(row_number() OVER (PARTITION BY alert_id ORDER BY pass, o, i) AS INTEGER) AS position, pass, rule, weight, subject, listed FROM ev"""

ORACLE = {
    "cacao_quarantine": O.scored_ctes() + """
SELECT 'kept' AS outcome, row_number() OVER (ORDER BY started_at DESC, alert_id) AS nth, alert_id, started_at
FROM (SELECT alert_id, strftime("timestamp", '%Y-%m-%d %H:%M:%S') AS started_at FROM scp WHERE event_id % 59 <> 0 AND event_id % 47 <> 0)
UNION ALL SELECT 'unparsable', count(*), NULL, NULL FROM scp WHERE event_id % 59 = 0
UNION ALL SELECT 'incomplete', count(*), NULL, NULL FROM scp WHERE event_id % 59 <> 0 AND event_id % 47 = 0""",
    "request_scores": _REQUESTED + O.scored_ctes()[len("WITH " + _ALERTS):] + """
SELECT alert_id, event_type, confidence_score, verification_status, severity, confidence, playbook_state,
  CAST(1 + greatest(n2_raw, 1) + greatest(n3_raw, 1) AS INTEGER) AS n_evidence FROM scp""",
    "evidence_long": _EVIDENCE,
    "alert_cards": O.scored_ctes() + """
SELECT alert_id, coalesce(nullif(event_type, ''), nullif(substr(raw_log, 1, 60), ''), alert_id) AS title,
  CASE playbook_state WHEN 'ALERT_RECEIVED' THEN 'New' WHEN 'RESOLVED' THEN 'Resolved' WHEN 'FAILED_DEFENCE' THEN 'Failed Defence'
       ELSE playbook_state END AS status_label,
  'pending,pending,pending,pending,pending,pending,pending' AS step_status,
  coalesce(nullif(source_ip, ''), 'Unknown') AS attacker_host,
  coalesce(nullif(event_type, ''), nullif(dest_ip, ''), 'Unknown') AS target_account,
  substr(sha256(""" + O.SEALED_PAYLOAD + """), 1, 16) || '...' AS payload_ref,
  round(confidence * 100, 1) AS confidence_pct, 'green' AS gauge_band,
  CAST(n_ti + n_cve_hits + n_proc_hits + CASE WHEN decoy_asset_id IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS n_threat,
  CAST(CASE WHEN len(gaps) > 0 THEN 1 ELSE 0 END + f_ingress + f_eastwest + CASE WHEN len(k_lateral) > 0 THEN 1 ELSE 0 END
       + n_risk + CASE WHEN n2_raw = 0 THEN 1 ELSE 0 END AS INTEGER) AS n_warn,
  CAST(1 + greatest(n2_raw, 1) + greatest(n3_raw, 1) + CASE WHEN decoy_asset_id IS NOT NULL THEN 1 ELSE 0 END
       - (n_ti + n_cve_hits + n_proc_hits + CASE WHEN decoy_asset_id IS NOT NULL THEN 1 ELSE 0 END)
       - (CASE WHEN len(gaps) > 0 THEN 1 ELSE 0 END + f_ingress + f_eastwest + CASE WHEN len(k_lateral) > 0 THEN 1 ELSE 0 END
          + n_risk + CASE WHEN n2_raw = 0 THEN 1 ELSE 0 END) AS INTEGER) AS n_ok,
  1 AS n_pass1, CAST(greatest(n2_raw, 1) AS INTEGER) AS n_pass2, CAST(greatest(n3_raw, 1) AS INTEGER) AS n_pass3
FROM scp""",
    "repeat_attackers": "WITH " + O.ALERTS_V_SQL.strip() + """,
b AS (SELECT alert_id, source_ip, epoch_us("timestamp") AS t,
        CASE WHEN len(string_split(source_ip, '.')) = 4 THEN split_part(source_ip, '.', 1) || '.' || split_part(source_ip, '.', 2) || '.0.0/16'
             ELSE '0.0.0.0/16' END AS slash16
      FROM alerts_v WHERE source_ip IS NOT NULL AND source_ip <> '')
SELECT a.alert_id, a.slash16, count(DISTINCT c.source_ip) AS n_sources, count(DISTINCT c.source_ip) > 1 AS repeat_attacker
FROM b a JOIN b c ON a.slash16 = c.slash16 AND c.t BETWEEN a.t - 600000000 AND a.t
GROUP BY ALL""",
    "cacao_history": O.scored_ctes() + f"""
SELECT 'pb_' || alert_id AS playbook_id, alert_id, 'RESOLVED' AS outcome, CAST(len(svc_actions) AS INTEGER) AS n_action_steps,
  CAST(2 * len(svc_actions) AS INTEGER) AS duration_s, '{AS_OF[:19]}' AS started_at, 'UNKNOWN' AS severity,
  array_to_string([CAST(2 * (i - 1) AS VARCHAR) || ' ' || a FOR a, i IN svc_actions], '; ') AS timeline
FROM scp""",
    "training_export": """
SELECT CAST(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS INTEGER) AS label, count(*) AS n_rows,
  count(CASE WHEN event_id % 4 <> 2 THEN 1 END) AS n_with_ioc
FROM events GROUP BY 1""",
}

"""Tier, decoy, response-playbook and response-shape queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil.operators import triage as TR
from vigil.plans import oracle_sql as O
from vigil.plans.common import alerts, verified_alerts
from vigil.plans.scoring import response_shape as shape_of
from vigil.plans.scoring import score_alerts
from vigil.session import shared_path
from vigil.sources import dims
from vigil.sources.testviews import AS_OF


def _tiers(spark, sf_dir) -> DataFrame:
    a = TR.detect_decoys(TR.classify(alerts(spark, sf_dir)))
    return a.withColumn("base_severity", F.col("severity")).withColumn(
        "evidence_trail", F.array().cast("array<string>")).transform(TR.apply_decoy_override)


def severity_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tiers(spark, sf_dir).select("alert_id", "event_type", "p_attack", "base_severity",
                                        "decoy_asset_id", "severity", "confidence")


def severity_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _tiers(spark, sf_dir).groupBy("severity").agg(F.count(F.lit(1)).alias("n_alerts"))
    tiers = dims.dim_severity(spark).select("severity", "severity_ord")
    j = tiers.join(counts, "severity", "left").withColumn("n_alerts", F.coalesce("n_alerts", F.lit(0)).cast("bigint"))
    total = F.sum("n_alerts").over(Window.partitionBy())
    return j.select("severity", "severity_ord", "n_alerts",
                    F.when(total > 0, F.col("n_alerts").cast("double") * F.lit(100.0) / total.cast("double"))
                     .otherwise(F.lit(0.0)).alias("share_pct"))


def decoy_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = TR.detect_decoys(alerts(spark, sf_dir)).where("decoy_hit")
    return d.select("alert_id", "event_type", F.col("decoy_asset_id").alias("asset_id"),
                    TR.decoy_description(F.col("decoy_asset_id")).alias("description"))


def decoy_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    reg = TR.decoy_registry(TR.detect_decoys(alerts(spark, sf_dir)), spark)
    return reg.select("asset_id", "asset_type", "description", "is_triggered", "trigger_count",
                      F.date_format("last_triggered", "yyyy-MM-dd HH:mm:ss").alias("last_triggered"))


def _scored(spark, sf_dir) -> DataFrame:
    return score_alerts(alerts(spark, sf_dir), AS_OF)


def response_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scored(spark, sf_dir)
    return s.select("alert_id", "severity", "playbook_state",
                    F.size("playbook_actions").alias("n_actions"),
                    F.array_join(F.transform("playbook_actions", lambda a: a["action_taken"]), " | ").alias("actions"))


def _full_playbooks(spark, sf_dir) -> DataFrame:
    """Full response machine fed with the verification score as blast radius
    and a prior attempt count derived from the user (covers every branch)."""
    v = TR.apply_decoy_override(TR.detect_decoys(TR.classify(verified_alerts(spark, sf_dir))))
    attempts = (F.col("user_id") % 4).cast("int")
    return (v.withColumn("prior_attempts", attempts)
             .withColumn("actions_log", TR.response_playbook(F.col("severity"), F.col("source_ip"),
                                                             F.col("confidence_score"), attempts, F.col("timestamp"))))


def response_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _full_playbooks(spark, sf_dir)
    blocked = F.exists("actions_log", lambda a: a["action_taken"].startswith("Blocked individual IP"))
    return p.select("alert_id", "severity", TR.final_state(F.col("actions_log")).alias("current_state"),
                    F.size("actions_log").alias("n_actions"),
                    (F.col("prior_attempts") + F.when(blocked, 1).otherwise(0)).alias("remediation_attempts"),
                    F.get(F.filter("actions_log", lambda a: a["asn_block"].isNotNull()), 0)["asn_block"].alias("asn_block"),
                    F.array_join(F.transform("actions_log", lambda a: a["to_state"]), ">").alias("path"))


def action_log_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _full_playbooks(spark, sf_dir)
    # ``_outer`` generators: the log is never empty, and the plain form makes the
    # optimizer infer a size(log) > 0 filter that it pushes below (and so
    # duplicates) the whole scoring projection.
    # A step's predecessor is its neighbour in the log, so no shuffle is needed.
    steps = F.transform("actions_log", lambda a, i: F.struct(
        (i + 1).alias("step"), a["from_state"].alias("from_state"), a["to_state"].alias("to_state"),
        a["action_taken"].alias("action_taken"), a["reason"].alias("reason"),
        F.get(F.col("actions_log"), i - 1)["to_state"].alias("prev_to_state")))
    e = p.select("alert_id", F.explode_outer(steps).alias("a"))
    return e.select("alert_id", "a.step", "a.from_state", "a.to_state", "a.action_taken", "a.reason", "a.prev_to_state")


def cacao_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scored(spark, sf_dir)
    wf = s.select("alert_id", F.explode_outer(TR.cacao_workflow(F.col("playbook_actions"))).alias("w"))
    return wf.select("alert_id", F.col("w.step_id").alias("step_id"), F.col("w.type").alias("type"),
                     F.col("w.name").alias("name"), F.col("w.on_completion").alias("on_completion"))


def playbook_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scored(spark, sf_dir)
    wf = TR.cacao_workflow(F.col("playbook_actions"))
    n_act = F.size(F.filter(wf, lambda w: w["type"] == "action"))
    return s.select(F.concat(F.lit("pb_"), F.col("alert_id")).alias("playbook_id"), "alert_id",
                    F.lit("RESOLVED").alias("outcome"), n_act.alias("n_action_steps"),
                    (n_act * 2).alias("duration_s"),
                    F.array_join(F.transform(F.filter(wf, lambda w: w["type"] == "action"),
                                             lambda w, i: (i * 2).cast("string")), ",").alias("timeline_offsets"))


def response_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = shape_of(_scored(spark, sf_dir))
    return r.withColumn("n_evidence", F.size("evidence_trail")).drop("evidence_trail", "verification_status")


def response_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Response job: required keys → full response machine → narrative →
    seal → stored snapshot → integrity check of what was stored, one row per
    alert (rows missing a key are rejected)."""
    from vigil.operators.vault import field_payload, seal
    p = _full_playbooks(spark, sf_dir)
    ok = F.col("alert_id").isNotNull() & F.col("severity").isNotNull() & F.col("confidence_score").isNotNull()
    p = p.where(ok).withColumn("final_state", TR.final_state(F.col("actions_log"))) \
         .withColumn("playbook_narrative", TR.playbook_narrative(F.col("alert_id"), F.col("actions_log")))
    p = p.withColumn("_log", F.transform("actions_log", lambda a: F.concat_ws(">", a["from_state"], a["to_state"], a["action_taken"], a["reason"])))
    sealed = seal(p, field_payload(p, ["alert_id", "severity", "final_state", "playbook_narrative", "_log"]),
                  captured_at=F.lit(AS_OF).cast("timestamp"))
    store = shared_path(spark, "response-snapshots")
    (sealed.select("alert_id", "final_state", F.size("actions_log").alias("n_actions"), "playbook_narrative", "payload", "sha256")
     .write.parquet(store))
    stored = spark.read.parquet(store)
    return stored.select("alert_id", "final_state", "n_actions", "playbook_narrative", F.col("sha256").alias("vault_hash"),
                         (F.sha2(F.col("payload"), 256) == F.col("sha256")).alias("integrity_verified"))


QUERIES = {
    "response_job": response_job,
    "severity_tiers": severity_tiers,
    "severity_distribution": severity_distribution,
    "decoy_hits": decoy_hits,
    "decoy_registry": decoy_registry,
    "response_service": response_service,
    "response_full": response_full,
    "action_log_long": action_log_long,
    "cacao_steps": cacao_steps,
    "playbook_history": playbook_history,
    "response_shape": response_shape,
}

_ALERTS = "WITH " + O.ALERTS_V_SQL.strip()
_TIERS = _ALERTS + f""",
t0 AS (SELECT *, {O.p_attack_sql()} AS p_attack, {O.decoy_sql()} AS decoy_asset_id FROM alerts_v),
t AS (SELECT alert_id, event_type, p_attack, {O.tier_sql('p_attack')} AS base_severity, decoy_asset_id,
        CASE WHEN decoy_asset_id IS NOT NULL THEN 'CRITICAL' ELSE {O.tier_sql('p_attack')} END AS severity,
        CASE WHEN decoy_asset_id IS NOT NULL THEN 1.0::DOUBLE ELSE round(p_attack, 4)::DOUBLE END AS confidence,
        "timestamp"
      FROM t0)"""
_TIER_DIM = "(VALUES " + ", ".join(f"('{n}', {i})" for i, (n, _) in enumerate(dims.SEVERITY_TIERS)) + ") AS d(severity, severity_ord)"
_DECOY_DIM = "(VALUES " + ", ".join(f"('{a}', '{t}', '{d}')" for a, t, d in dims.DECOYS) + ") AS d(asset_id, asset_type, description)"
_NL = "chr(10)"


def _m2_sql() -> str:
    """Full response machine in SQL (blast = verification score, attempts = user_id % 4)."""
    return O.scored_ctes() + f""",
m2 AS (
  SELECT alert_id, severity, coalesce(source_ip, '') AS src, confidence_score AS blast, CAST(user_id % 4 AS INTEGER) AS prior,
    CASE WHEN coalesce(source_ip, '') = '' THEN '0.0.0.0/16'
         WHEN len(string_split(source_ip, '.')) = 4 THEN split_part(source_ip, '.', 1) || '.' || split_part(source_ip, '.', 2) || '.0.0/16'
         ELSE '0.0.0.0/16' END AS subnet
  FROM sc
),
m2b AS (
  SELECT *, CASE WHEN severity IN ('HIGH', 'CRITICAL') AND prior + 1 >= 3 THEN 'fail'
                 WHEN severity IN ('HIGH', 'CRITICAL') AND blast > 80 THEN 'asn'
                 WHEN severity IN ('HIGH', 'CRITICAL') THEN 'block'
                 WHEN severity = 'MEDIUM' AND blast > 60 THEN 'esc'
                 ELSE 'low' END AS branch
  FROM m2
),
m2l AS (
  SELECT *, CASE branch
    WHEN 'fail' THEN [{{'f':'ALERT_RECEIVED','t':'INITIAL_TRIAGE','a':'Alert received and parsed','r':'Initial ingestion of alert data.'}},
                      {{'f':'INITIAL_TRIAGE','t':'IP_BLOCKED','a':'Automated triage assessment completed','r':'Severity is ' || severity || '.'}},
                      {{'f':'IP_BLOCKED','t':'IP_BLOCKED','a':'Blocked individual IP: ' || src,'r':'Isolation mandated by playbook rules.'}},
                      {{'f':'IP_BLOCKED','t':'FAILED_DEFENCE','a':'FAILED_DEFENCE — 3 automated remediation attempts failed. Escalating to L2.','r':'Failed to remediate threat within allowed attempts/parameters.'}},
                      {{'f':'FAILED_DEFENCE','t':'FAILED_DEFENCE','a':'L2 analyst notified via alert queue.','r':'Automatic notification.'}}]
    WHEN 'asn' THEN [{{'f':'ALERT_RECEIVED','t':'INITIAL_TRIAGE','a':'Alert received and parsed','r':'Initial ingestion of alert data.'}},
                      {{'f':'INITIAL_TRIAGE','t':'IP_BLOCKED','a':'Automated triage assessment completed','r':'Severity is ' || severity || '.'}},
                      {{'f':'IP_BLOCKED','t':'IP_BLOCKED','a':'Blocked individual IP: ' || src,'r':'Isolation mandated by playbook rules.'}},
                      {{'f':'IP_BLOCKED','t':'ASN_BLOCKED','a':'Expanded block to subnet ' || subnet || ' — attacker switched IPs','r':'Attacker rotating IPs inside the same ASN block.'}},
                      {{'f':'ASN_BLOCKED','t':'RESOLVED','a':'Incident closed','r':'Threat mitigated successfully or marked as false positive.'}}]
    WHEN 'block' THEN [{{'f':'ALERT_RECEIVED','t':'INITIAL_TRIAGE','a':'Alert received and parsed','r':'Initial ingestion of alert data.'}},
                      {{'f':'INITIAL_TRIAGE','t':'IP_BLOCKED','a':'Automated triage assessment completed','r':'Severity is ' || severity || '.'}},
                      {{'f':'IP_BLOCKED','t':'IP_BLOCKED','a':'Blocked individual IP: ' || src,'r':'Isolation mandated by playbook rules.'}},
                      {{'f':'IP_BLOCKED','t':'RESOLVED','a':'Incident closed','r':'Threat mitigated successfully or marked as false positive.'}}]
    WHEN 'esc' THEN [{{'f':'ALERT_RECEIVED','t':'INITIAL_TRIAGE','a':'Alert received and parsed','r':'Initial ingestion of alert data.'}},
                      {{'f':'INITIAL_TRIAGE','t':'ESCALATED_TO_L2','a':'Automated triage assessment completed','r':'Severity is MEDIUM with high blast radius (' || CAST(blast AS VARCHAR) || ').'}},
                      {{'f':'ESCALATED_TO_L2','t':'ESCALATED_TO_L2','a':'Escalated to human L2 analyst','r':'Complexity or blast radius exceeds automated playbook capabilities.'}}]
    ELSE [{{'f':'ALERT_RECEIVED','t':'INITIAL_TRIAGE','a':'Alert received and parsed','r':'Initial ingestion of alert data.'}},
          {{'f':'INITIAL_TRIAGE','t':'RESOLVED','a':'Automated triage assessment completed','r':'Severity ' || severity || ' does not require immediate blocking.'}},
          {{'f':'RESOLVED','t':'RESOLVED','a':'Incident closed','r':'Threat mitigated successfully or marked as false positive.'}}]
  END AS log
  FROM m2b
)"""


_JOB = """,
j AS (SELECT alert_id, severity, array_to_string(list_transform(log, lambda x: concat_ws('>', x.f, x.t, x.a, x.r)), ',') AS log_text, log[len(log)].t AS final_state, CAST(len(log) AS INTEGER) AS n_actions,
        'Incident ' || alert_id || ': Automated response initiated at ' || strftime(ts0 + INTERVAL 1 SECOND, '%Y-%m-%dT%H:%M:%S.%f')
        || '.' || chr(10) || 'System executed ' || CAST(len(log) AS VARCHAR) || ' response actions.' || chr(10) || 'Final state: '
        || log[len(log)].t || ' at ' || strftime(ts0 + to_seconds(len(log)), '%Y-%m-%dT%H:%M:%S.%f') || '.' AS playbook_narrative
      FROM m2l JOIN (SELECT alert_id, "timestamp" AS ts0 FROM alerts_v) USING (alert_id))
SELECT alert_id, final_state, n_actions, playbook_narrative,
  sha256(""" + O.sealed_payload(["alert_id", "severity", "final_state", "playbook_narrative", "log_text"]) + """) AS vault_hash, true AS integrity_verified
FROM j"""


ORACLE = {
    "response_job": _m2_sql() + _JOB,
    "severity_tiers": _TIERS + "\nSELECT alert_id, event_type, p_attack, base_severity, decoy_asset_id, severity, confidence FROM t",
    "severity_distribution": _TIERS + f""",
c AS (SELECT severity, count(*) AS n FROM t GROUP BY 1),
j AS (SELECT d.severity, CAST(d.severity_ord AS INTEGER) AS severity_ord, CAST(coalesce(c.n, 0) AS BIGINT) AS n_alerts
      FROM {_TIER_DIM} LEFT JOIN c ON c.severity = d.severity)
SELECT severity, severity_ord, n_alerts,
  CASE WHEN sum(n_alerts) OVER () > 0 THEN CAST(n_alerts AS DOUBLE) * CAST(100.0 AS DOUBLE) / CAST(sum(n_alerts) OVER () AS DOUBLE) ELSE 0.0 END AS share_pct
FROM j""",
    "decoy_hits": _ALERTS + f""",
d0 AS (SELECT alert_id, event_type, {O.decoy_sql()} AS asset_id FROM alerts_v)
SELECT alert_id, event_type, d0.asset_id, d.description FROM d0 JOIN {_DECOY_DIM} USING (asset_id)""",
    "decoy_registry": _ALERTS + f""",
d0 AS (SELECT "timestamp", {O.decoy_sql()} AS asset_id FROM alerts_v),
c AS (SELECT asset_id, count(*) AS n, max("timestamp") AS last_ts FROM d0 WHERE asset_id IS NOT NULL GROUP BY 1)
SELECT d.asset_id, d.asset_type, d.description, coalesce(c.n, 0) > 0 AS is_triggered,
  CAST(coalesce(c.n, 0) AS BIGINT) AS trigger_count, strftime(c.last_ts, '%Y-%m-%d %H:%M:%S') AS last_triggered
FROM {_DECOY_DIM} LEFT JOIN c ON c.asset_id = d.asset_id""",
    "response_service": O.scored_ctes() + """
SELECT alert_id, severity, playbook_state, CAST(len(svc_actions) AS INTEGER) AS n_actions,
  array_to_string(svc_actions, ' | ') AS actions FROM scp""",
    "response_full": _m2_sql() + """
SELECT alert_id, severity, log[len(log)].t AS current_state, CAST(len(log) AS INTEGER) AS n_actions,
  prior + CASE WHEN branch IN ('fail', 'asn', 'block') THEN 1 ELSE 0 END AS remediation_attempts,
  CASE WHEN branch = 'asn' THEN subnet END AS asn_block,
  array_to_string(list_transform(log, lambda x: x.t), '>') AS path
FROM m2l""",
    "action_log_long": _m2_sql() + """,
ex AS (SELECT alert_id, i, log[i] AS a FROM (SELECT alert_id, log, generate_subscripts(log, 1) AS i FROM m2l))
SELECT alert_id, CAST(i AS INTEGER) AS step, a.f AS from_state, a.t AS to_state, a.a AS action_taken, a.r AS reason,
  lag(a.t) OVER (PARTITION BY alert_id ORDER BY i) AS prev_to_state
FROM ex""",
    "cacao_steps": O.scored_ctes() + """,
ex AS (SELECT alert_id, len(svc_actions) AS n, i, svc_actions[i] AS nm
       FROM (SELECT alert_id, svc_actions, generate_subscripts(svc_actions, 1) AS i FROM scp))
SELECT alert_id, 'start--1' AS step_id, 'start' AS type, NULL AS name, 'action--1' AS on_completion FROM scp
UNION ALL
SELECT alert_id, 'action--' || CAST(i AS VARCHAR), 'action', nm,
  CASE WHEN i < n THEN 'action--' || CAST(i + 1 AS VARCHAR) ELSE 'end--' || CAST(n AS VARCHAR) END FROM ex
UNION ALL
SELECT alert_id, 'end--' || CAST(len(svc_actions) AS VARCHAR), 'end', NULL, NULL FROM scp""",
    "playbook_history": O.scored_ctes() + """
SELECT 'pb_' || alert_id AS playbook_id, alert_id, 'RESOLVED' AS outcome,
  CAST(len(svc_actions) AS INTEGER) AS n_action_steps, CAST(2 * len(svc_actions) AS INTEGER) AS duration_s,
  CASE WHEN len(svc_actions) = 1 THEN '0' ELSE '0,2' END AS timeline_offsets
FROM scp""",
    "response_shape": O.scored_ctes() + f"""
SELECT alert_id, severity, confidence, blast_radius, playbook_state,
  'SUMMARY: A ' || severity || '-severity ' || event_type || ' alert was triggered' || {_NL} || 'from ' || coalesce(source_ip, 'N/A')
    || ' with ' || CAST(CAST(round_even(confidence * 100, 0) AS BIGINT) AS VARCHAR) || '% confidence.' || {_NL}
    || 'TECHNIQUE: Suspicious activity detected via severity_raw pattern (T1059).' || {_NL} || 'ACTION: ISOLATE_HOST' AS summary,
  'INCIDENT NARRATIVE:' || {_NL} || array_to_string(list_transform(svc_actions, lambda a: '- ' || a || {_NL}), '')
    || 'The incident was closed and logged per SOC protocol.' AS narrative,
  sha256({O.SEALED_PAYLOAD}) AS vault_hash,
  coalesce(source_ip, '') AS source_ip, coalesce(dest_ip, '') AS dest_ip, coalesce(port, 0) AS port,
  coalesce(event_type, '') AS event_type, false AS honeypot_triggered, '' AS triggered_asset_id,
  coalesce(protocol, '') AS protocol, coalesce(accessed_path, '') AS accessed_path,
  strftime("timestamp", '%Y-%m-%d %H:%M:%S') AS "timestamp",
  CAST(1 + greatest(n2_raw, 1) + greatest(n3_raw, 1) + CASE WHEN decoy_asset_id IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS n_evidence
FROM scp""",
}

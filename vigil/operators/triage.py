"""Severity tiers, decoy detection and response playbooks as column rules.

The reference runs per-alert state graphs; both graphs are bounded and
acyclic (at most five steps), so each becomes one ``CASE`` producing an
``array<struct>`` action log.  No iteration, no shuffle, same code on batch
and streaming DataFrames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.text import strip
from vigil.functions.net import slash16
from vigil.sources import dims

# ---------------------------------------------------------------------------
# FIXED VALUES — action-log wording of the two response machines.
# ---------------------------------------------------------------------------
# Service machine: (action_taken, reason) per step kind.
SVC_RECEIVE = ("Alert Ingestion", "System received new raw SIEM log")
SVC_BLOCK_REASON = "High severity threat detected"  # action: "Blocked IP {source_ip}"
SVC_ASN_REASON = "Attacker switched IPs within subnet"  # action: "Blocked ASN {a.b.0.0/16}"
SVC_ESCALATE = ("L2 Escalation", "Medium threat with high blast radius or defense failure")
SVC_ESCALATE_BLAST = 5.0
# Response machine.
RSP_RECEIVE = ("Alert received and parsed", "Initial ingestion of alert data.")
RSP_TRIAGE_ACTION = "Automated triage assessment completed"
RSP_BLOCK_REASON = "Isolation mandated by playbook rules."  # action: "Blocked individual IP: {src_ip}"
RSP_ASN_REASON = "Attacker rotating IPs inside the same ASN block."  # action: "Expanded block to subnet {s} — attacker switched IPs"
RSP_ESCALATE = ("Escalated to human L2 analyst", "Complexity or blast radius exceeds automated playbook capabilities.")
RSP_RESOLVE = ("Incident closed", "Threat mitigated successfully or marked as false positive.")
RSP_FAILED = [("FAILED_DEFENCE — 3 automated remediation attempts failed. Escalating to L2.",
               "Failed to remediate threat within allowed attempts/parameters."),
              ("L2 analyst notified via alert queue.", "Automatic notification.")]
RSP_ESCALATE_BLAST = 60
RSP_ASN_BLAST = 80
RSP_MAX_ATTEMPTS = 3
HIGH_TIERS = ["HIGH", "CRITICAL"]
# ---------------------------------------------------------------------------

ACTION_TYPE = ("struct<step:int,timestamp:timestamp,from_state:string,to_state:string,"
               "action_taken:string,reason:string,asn_block:string>")


# ------------------------------------------------------------ classification
def fixed_event_probability(event_type: Column) -> Column:
    expr = None
    for p, events in dims.EVENT_PROBABILITY_GROUPS:
        cond = event_type.isin(*events)
        expr = F.when(cond, F.lit(p)) if expr is None else expr.when(cond, F.lit(p))
    return expr


def attack_probability(event_type: Column, model_p: Column | None = None) -> Column:
    """Fixed per-event probability, else the model's, else the no-model default."""
    fallback = F.lit(dims.DEFAULT_ATTACK_PROBABILITY)
    return F.coalesce(fixed_event_probability(event_type), model_p if model_p is not None else fallback, fallback)


def severity_tier(p: Column) -> Column:
    """Tier of a probability in [0, 1]; null outside the domain (rejected)."""
    expr = F.when((p < 0) | (p > 1) | p.isNull(), F.lit(None).cast("string")).when(p == 1.0, F.lit("CRITICAL"))
    tiers = dims.SEVERITY_TIERS
    for i, (name, lo) in enumerate(tiers):
        hi = tiers[i + 1][1] if i + 1 < len(tiers) else None
        cond = (p >= lo) if hi is None else ((p >= lo) & (p < hi))
        expr = expr.when(cond, F.lit(name))
    return expr


def severity_ord(sev: Column) -> Column:
    return F.array_position(F.array(*[F.lit(n) for n, _ in dims.SEVERITY_TIERS]), sev).cast("int") - 1


def classify(df: DataFrame, model_p: Column | None = None) -> DataFrame:
    """Add p_attack, severity and confidence (4 dp)."""
    return (df.withColumn("p_attack", attack_probability(F.col("event_type"), model_p))
              .withColumn("severity", severity_tier(F.col("p_attack")))
              .withColumn("confidence", F.round(F.col("p_attack"), 4)))


# ------------------------------------------------------------------- decoys
def decoy_asset(raw_log: Column, accessed_path: Column, event_type: Column, protocol: Column,
                dest_port: Column | None = None) -> Column:
    """First matching decoy rule (case-sensitive substrings), else null.

    ``dest_port`` defaults to 0: the scoring service never passes a
    destination port to the rules, so the port-2222 decoy only fires when a
    port column is given explicitly."""
    raw = F.coalesce(raw_log, F.lit(""))
    path = F.coalesce(accessed_path, F.lit(""))
    port = F.coalesce(dest_port, F.lit(0)) if dest_port is not None else F.lit(0)
    proto = F.coalesce(protocol, F.lit(""))
    return (F.when(path.contains(dims.DECOY_SALARY_PATH) | raw.contains(dims.DECOY_SALARY_LOG), F.lit("HP_SALARY_FILE"))
            .when(path.contains(dims.DECOY_DB_CRED) | raw.contains(dims.DECOY_DB_CRED), F.lit("HP_DB_CRED"))
            .when(path.contains(dims.DECOY_ADMIN_PATH) & F.coalesce(event_type.isin(*dims.DECOY_ADMIN_EVENTS), F.lit(False)),
                  F.lit("HP_ADMIN_LOGIN"))
            .when((port == dims.DECOY_SSH_PORT) & proto.isin(*dims.DECOY_SSH_PROTOCOLS), F.lit("HP_SSH_2222"))
            .when(path.contains(dims.DECOY_CLOUD_PATH) | raw.contains(dims.DECOY_CLOUD_LOG), F.lit("HP_CLOUD_CONFIG")))


def decoy_description(asset: Column) -> Column:
    m = F.create_map(*[x for a, _, d in dims.DECOYS for x in (F.lit(a), F.lit(d))])
    return F.try_element_at(m, asset)


def detect_decoys(df: DataFrame, port_col: str | None = None) -> DataFrame:
    port = F.col(port_col) if port_col else None
    path = F.col("accessed_path") if "accessed_path" in df.columns else F.lit(None).cast("string")
    return (df.withColumn("decoy_asset_id", decoy_asset(F.col("raw_log"), path, F.col("event_type"),
                                                        F.col("protocol"), port))
              .withColumn("decoy_hit", F.col("decoy_asset_id").isNotNull()))


def apply_decoy_override(df: DataFrame, flag_in_response: bool = False) -> DataFrame:
    """A decoy hit forces CRITICAL / 1.0 and appends an evidence line.  The
    scoring service does not copy the flag into its response, so
    ``honeypot_triggered`` stays false unless ``flag_in_response``."""
    hit = F.col("decoy_hit")
    line = F.concat(F.lit("HONEYPOT TRIGGERED: decoy "), F.col("decoy_asset_id"),
                    F.lit(" touched; deception hits carry no false positives."))
    out = (df.withColumn("severity", F.when(hit, F.lit("CRITICAL")).otherwise(F.col("severity")))
             .withColumn("confidence", F.when(hit, F.lit(1.0)).otherwise(F.col("confidence")))
             .withColumn("evidence_trail", F.when(hit, F.concat(F.col("evidence_trail"), F.array(line)))
                         .otherwise(F.col("evidence_trail"))))
    flag = hit if flag_in_response else F.lit(False)
    return (out.withColumn("honeypot_triggered", flag)
               .withColumn("triggered_asset_id", F.when(flag, F.col("decoy_asset_id")).otherwise(F.lit(""))))


def decoy_registry(hits: DataFrame, spark) -> DataFrame:
    """Per decoy: triggered ever, count and last trigger time (all five listed).

    ``hits`` has ``decoy_asset_id`` and ``timestamp``; the partial aggregate
    runs map-side, so only one row per asset and partition is shuffled."""
    agg = (hits.where(F.col("decoy_asset_id").isNotNull())
               .groupBy(F.col("decoy_asset_id").alias("asset_id"))
               .agg(F.count(F.lit(1)).alias("trigger_count"), F.max("timestamp").alias("last_triggered")))
    reg = dims.dim_decoys(spark)
    return (reg.join(agg, "asset_id", "left")
               .select("asset_id", "asset_type", "description",
                       (F.coalesce(F.col("trigger_count"), F.lit(0)) > 0).alias("is_triggered"),
                       F.coalesce(F.col("trigger_count"), F.lit(0)).cast("bigint").alias("trigger_count"),
                       F.col("last_triggered"), "rule_ord"))


# ---------------------------------------------------------------- responses
def _act(step: int, ts: Column, frm: str | Column, to: str, action, reason, asn: Column | None = None) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(F.lit(step).alias("step"),
                    (ts + F.make_interval(secs=F.lit(step))).alias("timestamp"),
                    lit(frm).cast("string").alias("from_state"), F.lit(to).alias("to_state"),
                    lit(action).cast("string").alias("action_taken"), lit(reason).cast("string").alias("reason"),
                    (asn if asn is not None else F.lit(None)).cast("string").alias("asn_block"))


def service_playbook(severity: Column, source_ip: Column, blast: Column, ts: Column,
                     repeat_attacker: Column | None = None) -> Column:
    """Action log of the scoring service's response machine.

    Repeat-attacker detection is not wired into the reference's state, so
    ``repeat_attacker`` defaults to false (ASN block never taken)."""
    repeat = repeat_attacker if repeat_attacker is not None else F.lit(False)
    src = F.coalesce(source_ip, F.lit("0.0.0.0"))
    recv = _act(1, ts, "ALERT_RECEIVED", "INITIAL_TRIAGE", *SVC_RECEIVE)
    block = _act(2, ts, "INITIAL_TRIAGE", "IP_BLOCKED", F.concat(F.lit("Blocked IP "), src), SVC_BLOCK_REASON)
    asn = _act(3, ts, "IP_BLOCKED", "ASN_BLOCKED", F.concat(F.lit("Blocked ASN "), slash16(src)), SVC_ASN_REASON)
    esc = _act(2, ts, "INITIAL_TRIAGE", "ESCALATED_TO_L2", *SVC_ESCALATE)
    high = severity.isin(*HIGH_TIERS)
    return (F.when(high & repeat, F.array(recv, block, asn))
            .when(high, F.array(recv, block))
            .when((severity == "MEDIUM") & (F.coalesce(blast, F.lit(0.0)) > SVC_ESCALATE_BLAST), F.array(recv, esc))
            .otherwise(F.array(recv)))


def response_playbook(severity: Column, src_ip: Column, blast: Column, attempts: Column, ts: Column) -> Column:
    """Action log of the full response machine (triage → block → ASN / failed
    defence / resolve).  Attempts are incremented by the block step before
    the three-strikes test, which takes priority over the blast test."""
    sev = F.coalesce(severity, F.lit(""))
    b = F.coalesce(blast, F.lit(0))
    src = F.coalesce(src_ip, F.lit(""))
    high = sev.isin(*HIGH_TIERS)
    medium_hot = (sev == "MEDIUM") & (b > RSP_ESCALATE_BLAST)
    recv = _act(1, ts, "ALERT_RECEIVED", "INITIAL_TRIAGE", *RSP_RECEIVE)
    tri_reason_high = F.concat(F.lit("Severity is "), sev, F.lit("."))
    tri_reason_med = F.concat(F.lit("Severity is MEDIUM with high blast radius ("), b.cast("string"), F.lit(")."))
    tri_reason_low = F.concat(F.lit("Severity "), sev, F.lit(" does not require immediate blocking."))
    tri_high = _act(2, ts, "INITIAL_TRIAGE", "IP_BLOCKED", RSP_TRIAGE_ACTION, tri_reason_high)
    tri_med = _act(2, ts, "INITIAL_TRIAGE", "ESCALATED_TO_L2", RSP_TRIAGE_ACTION, tri_reason_med)
    tri_low = _act(2, ts, "INITIAL_TRIAGE", "RESOLVED", RSP_TRIAGE_ACTION, tri_reason_low)
    block = _act(3, ts, "IP_BLOCKED", "IP_BLOCKED", F.concat(F.lit("Blocked individual IP: "), src), RSP_BLOCK_REASON)
    subnet = slash16(src)
    asn = _act(4, ts, "IP_BLOCKED", "ASN_BLOCKED",
               F.concat(F.lit("Expanded block to subnet "), subnet, F.lit(" — attacker switched IPs")),
               RSP_ASN_REASON, subnet)
    fail1 = _act(4, ts, "IP_BLOCKED", "FAILED_DEFENCE", *RSP_FAILED[0])
    fail2 = _act(5, ts, "FAILED_DEFENCE", "FAILED_DEFENCE", *RSP_FAILED[1])
    res_after_asn = _act(5, ts, "ASN_BLOCKED", "RESOLVED", *RSP_RESOLVE)
    res_after_block = _act(4, ts, "IP_BLOCKED", "RESOLVED", *RSP_RESOLVE)
    esc = _act(3, ts, "ESCALATED_TO_L2", "ESCALATED_TO_L2", *RSP_ESCALATE)
    res_low = _act(3, ts, "RESOLVED", "RESOLVED", *RSP_RESOLVE)
    attempts_after = F.coalesce(attempts, F.lit(0)) + 1
    return (F.when(high & (attempts_after >= RSP_MAX_ATTEMPTS), F.array(recv, tri_high, block, fail1, fail2))
            .when(high & (b > RSP_ASN_BLAST), F.array(recv, tri_high, block, asn, res_after_asn))
            .when(high, F.array(recv, tri_high, block, res_after_block))
            .when(medium_hot, F.array(recv, tri_med, esc))
            .otherwise(F.array(recv, tri_low, res_low)))


def final_state(log: Column) -> Column:
    return F.coalesce(F.get(log, F.size(log) - 1)["to_state"], F.lit("ALERT_RECEIVED"))


def in_progress_label(severity: Column) -> Column:
    return F.when(severity.isin(*HIGH_TIERS), F.lit("HOST_ISOLATED")).otherwise(F.lit("RESOLVED"))


def playbook_narrative(alert_id: Column, log: Column) -> Column:
    """Incident narrative: first / last timestamp, action count, final state."""
    iso = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    first_ts = F.date_format(F.get(log, 0)["timestamp"], iso)
    last_ts = F.date_format(F.get(log, F.size(log) - 1)["timestamp"], iso)
    return F.when(F.size(log) == 0, F.concat(F.lit("Incident "), alert_id, F.lit(": No response actions log."))) \
        .otherwise(F.concat(F.lit("Incident "), alert_id, F.lit(": Automated response initiated at "),
                            F.coalesce(first_ts, F.lit("unknown")), F.lit(".\nSystem executed "),
                            F.size(log).cast("string"), F.lit(" response actions.\nFinal state: "),
                            final_state(log), F.lit(" at "), F.coalesce(last_ts, F.lit("unknown")), F.lit(".")))


# ---------------------------------------------------------------- templates
def summary_template(severity: Column, event_type: Column, source_ip: Column, confidence: Column,
                     top_feature: Column) -> Column:
    """Three-line fallback summary (confidence as a whole percent, halves to even)."""
    pct = F.bround(F.coalesce(confidence.cast("double"), F.lit(0.0)) * 100, 0).cast("bigint").cast("string")
    return F.concat(F.lit("SUMMARY: A "), F.coalesce(severity, F.lit("UNKNOWN")), F.lit("-severity "),
                    F.coalesce(event_type, F.lit("unknown_event")), F.lit(" alert was triggered\nfrom "),
                    F.coalesce(source_ip, F.lit("N/A")), F.lit(" with "), pct, F.lit("% confidence.\nTECHNIQUE: "),
                    F.lit("Suspicious activity detected via "), F.coalesce(top_feature, F.lit("unknown_pattern")),
                    F.lit(" pattern (T1059).\nACTION: ISOLATE_HOST"))


def narrative_template(log: Column) -> Column:
    """Bullet list of the actions taken, or the fixed empty-log sentence."""
    bullets = F.array_join(F.transform(log, lambda a: F.concat(F.lit("- "), a["action_taken"], F.lit("\n"))), "")
    return F.when(F.size(log) == 0,
                  F.lit("INCIDENT NARRATIVE: No playbook actions were logged. The incident was closed and logged per SOC protocol.")) \
        .otherwise(F.concat(F.lit("INCIDENT NARRATIVE:\n"), bullets,
                            F.lit("The incident was closed and logged per SOC protocol.")))


def text_is_valid(text: Column) -> Column:
    return F.coalesce(F.length(strip(text)) > 20, F.lit(False))


def choose_text(external: Column, fallback: Column) -> Column:
    return F.when(text_is_valid(external), external).otherwise(fallback)


# -------------------------------------------------------------------- CACAO
def cacao_workflow(log: Column) -> Column:
    """Workflow entries start → action--1..n → end--n as array<struct>."""
    n = F.size(log)
    start = F.struct(F.lit("start--1").alias("step_id"), F.lit("start").alias("type"),
                     F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("description"),
                     F.lit(None).cast("string").alias("executed_at"), F.lit("action--1").alias("on_completion"))
    actions = F.transform(log, lambda a, i: F.struct(
        F.concat(F.lit("action--"), (i + 1).cast("string")).alias("step_id"),
        F.lit("action").alias("type"),
        F.coalesce(a["action_taken"], F.lit("Unknown Action")).alias("name"),
        F.coalesce(a["reason"], F.lit("")).alias("description"),
        F.coalesce(a["timestamp"].cast("string"), F.lit("")).alias("executed_at"),
        F.when(i + 1 < n, F.concat(F.lit("action--"), (i + 2).cast("string")))
         .otherwise(F.concat(F.lit("end--"), n.cast("string"))).alias("on_completion")))
    end = F.struct(F.concat(F.lit("end--"), n.cast("string")).alias("step_id"), F.lit("end").alias("type"),
                   F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("description"),
                   F.lit(None).cast("string").alias("executed_at"), F.lit(None).cast("string").alias("on_completion"))
    return F.concat(F.array(start), actions, F.array(end))


def cacao_document(alert_id: Column, log: Column, summary: Column, created: Column) -> Column:
    """CACAO playbook skeleton with its workflow map (ids derived from the alert)."""
    wf = cacao_workflow(log)
    return F.struct(
        F.lit("playbook").alias("type"), F.lit("cacao-2.0").alias("spec_version"),
        F.concat(F.lit("playbook--"), F.sha2(F.concat(F.lit("playbook|"), alert_id), 256).substr(1, 32)).alias("id"),
        F.concat(F.lit("SOC Response Playbook — Incident "), alert_id).alias("name"),
        F.coalesce(F.nullif(summary, F.lit("")), F.lit("Automated SOC response playbook.")).alias("description"),
        created.cast("string").alias("created"), created.cast("string").alias("modified"),
        F.concat(F.lit("identity--"), F.sha2(F.concat(F.lit("identity|"), alert_id), 256).substr(1, 32)).alias("created_by"),
        F.array(F.lit("investigation"), F.lit("remediation")).alias("playbook_types"),
        F.lit("start--1").alias("workflow_start"),
        F.map_from_arrays(F.transform(wf, lambda s: s["step_id"]),
                          F.transform(wf, lambda s: F.struct(s["type"].alias("type"), s["name"].alias("name"),
                                                             s["description"].alias("description"),
                                                             s["executed_at"].alias("executed_at"),
                                                             s["on_completion"].alias("on_completion")))).alias("workflow"))

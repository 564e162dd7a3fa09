"""Dashboard card fields and repeat-attacker windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions.net import slash16
from vigil.functions.ordered import running_totals
from vigil.sources import dims


def _markers(text: Column, markers: list[str]) -> Column:
    cond = F.lit(False)
    for m in markers:
        cond = cond | F.contains(text, F.lit(m))
    return cond


def evidence_tags(trail: Column) -> Column:
    """Per evidence line: pass number, threat / warn / ok tag, text without prefix."""
    return F.transform(trail, lambda t: F.struct(
        F.regexp_extract(t, r"(?i)^PASS\s+(\d)", 1).alias("pass"),
        F.when(_markers(t, dims.EVIDENCE_THREAT_MARKERS), F.lit("threat"))
         .when(_markers(t, dims.EVIDENCE_WARN_MARKERS), F.lit("warn")).otherwise(F.lit("ok")).alias("tag"),
        F.regexp_replace(t, r"(?i)^PASS\s+\d:\s*", "").alias("text")))


def state_label(state: Column) -> Column:
    m = F.create_map(*[x for k, v in dims.STATE_LABELS for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(m, state), state)


def step_list(state: Column) -> Column:
    steps = F.array(*[F.lit(s) for s in dims.DISPLAY_STEPS])
    cur = F.array_position(steps, state).cast("int") - 1
    return F.transform(steps, lambda s, i: F.struct(
        F.regexp_replace(state_label(s), "_", " ").alias("label"),
        F.when(i < cur, F.lit("completed")).when(i == cur, F.lit("active")).otherwise(F.lit("pending")).alias("status")))


def gauge_band(score: Column) -> Column:
    expr = None
    for bound, colour in dims.GAUGE_BANDS:
        expr = F.when(score > bound, F.lit(colour)) if expr is None else expr.when(score > bound, F.lit(colour))
    return expr.otherwise(F.lit("green"))


def card_fields(df: DataFrame) -> DataFrame:
    """Title, status label, step list, related entities, evidence tags,
    confidence percent, gauge band and the trimmed text-prompt context."""
    title = F.when(F.col("honeypot_triggered"),
                   F.concat(F.lit("Honeypot: "), F.coalesce(F.nullif(F.col("triggered_asset_id"), F.lit("")),
                                                              F.nullif(F.col("event_type"), F.lit("")),
                                                              F.lit("Decoy Asset Accessed")))) \
        .otherwise(F.coalesce(F.nullif(F.col("event_type"), F.lit("")),
                              F.nullif(F.substring(F.coalesce("raw_log", F.lit("")), 1, 60), F.lit("")), F.col("alert_id")))
    payload = F.when(F.coalesce(F.col("vault_hash"), F.lit("")) != "",
                     F.concat(F.substring("vault_hash", 1, 16), F.lit("..."))) \
        .otherwise(F.coalesce(F.nullif(F.col("accessed_path"), F.lit("")), F.lit("N/A")))
    top = F.col("top_features") if "top_features" in df.columns else F.lit(None).cast("array<string>")
    context = F.to_json(F.struct(F.coalesce("severity", F.lit("UNKNOWN")).alias("severity"),
                                 F.coalesce("event_type", F.lit("unknown_event")).alias("event_type"),
                                 F.coalesce("source_ip", F.lit("N/A")).alias("source_ip"),
                                 F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
                                 F.coalesce(top, F.array(F.lit("unknown"))).alias("top_features"),
                                 F.coalesce(F.transform("playbook_actions", lambda a: a["action_taken"]),
                                            F.array().cast("array<string>")).alias("playbook_actions")))
    return (df.withColumn("title", title)
              .withColumn("status_label", state_label(F.col("playbook_state")))
              .withColumn("steps", step_list(F.col("playbook_state")))
              .withColumn("attacker_host", F.coalesce(F.nullif(F.col("source_ip"), F.lit("")), F.lit("Unknown")))
              .withColumn("target_account", F.coalesce(F.nullif(F.col("event_type"), F.lit("")),
                                                       F.nullif(F.col("dest_ip"), F.lit("")), F.lit("Unknown")))
              .withColumn("payload_ref", payload)
              .withColumn("evidence_tags", evidence_tags(F.col("evidence_trail")))
              .withColumn("confidence_pct", F.round(F.coalesce("confidence", F.lit(0.0)) * 100, 1))
              .withColumn("gauge_band", gauge_band(F.coalesce("blast_radius", F.lit(0.0)) * 100))
              .withColumn("prompt_context", context))


def repeat_attackers(df: DataFrame, window_s: int = 600) -> DataFrame:
    """Distinct sources per /16 within the last ``window_s`` of each alert (both
    ends included; times are compared in microseconds).

    A sweep instead of a sliding set: a source counts from each of its alerts
    until its next one, or until the window has passed, so every alert gives one
    +1 and one -1.  Their running total per /16 is the number of sources.  It is
    taken over ranges of (/16, time), so a hot /16 is split over tasks, and the
    cost is linear in its alerts."""
    window = window_s * 1_000_000
    base = (df.where(F.col("source_ip").isNotNull() & (F.col("source_ip") != ""))
              .select("alert_id", "source_ip", F.unix_micros("timestamp").alias("t"),
                      slash16(F.col("source_ip")).alias("slash16")))
    seen = base.select("slash16", "source_ip", "t").distinct()
    following = F.lead("t").over(Window.partitionBy("slash16", "source_ip").orderBy("t"))
    until = F.least(F.coalesce(following, F.col("t") + window + 1), F.col("t") + window + 1)
    turns = (seen.withColumn("until", until)
             .select("slash16", F.explode(F.array(F.struct(F.col("t"), F.lit(1).alias("d")),
                                                  F.struct(F.col("until").alias("t"), F.lit(-1).alias("d")))).alias("x")))
    changes = turns.groupBy("slash16", F.col("x.t").alias("t")).agg(F.sum("x.d").alias("d"))
    totals = running_totals(changes, "t", ["d"], by=["slash16"]).select("slash16", "t", F.col("cum_d").alias("n_sources"))
    return (base.join(totals, ["slash16", "t"])
                .select("alert_id", "slash16", "n_sources", (F.col("n_sources") > 1).alias("repeat_attacker")))

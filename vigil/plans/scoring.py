"""End-to-end alert scoring as one lazily built plan.

source → indicators → verification → tier → decoy override → blast radius →
response → seal → texts.  Everything up to the blast-radius lookup is a
chain of projections (no shuffle).  The blast lookup joins on the node id;
adaptive execution broadcasts the node table where its measured size allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.ioc import with_iocs
from vigil.operators import triage as TR
from vigil.operators.vault import field_payload, seal
from vigil.operators.verify import verify

# The whole alert: its own fields, its indicators and every decision on it.
# Evidence and summary texts are rendered from these and not sealed apart.
SEAL_FIELDS = ["alert_id", "timestamp", "source_ip", "dest_ip", "port", "protocol", "event_type", "accessed_path",
               "processName", "raw_log", "ioc.sha256", "ioc.md5", "ioc.cve", "ioc.url", "ioc.ipv6", "ioc.domain",
               "ioc.process", "ioc.ipv4", "ioc.lateral_movement", "structural_gaps", "c1", "c2", "c3",
               "confidence_score", "verification_status", "severity", "confidence", "decoy_asset_id", "blast_radius",
               "playbook_state", "_action_names"]


def attach_blast(df: DataFrame, blast: DataFrame | None, node_col: str = "source_ip") -> DataFrame:
    """Left join to a (node, blast_radius_score) table; unknown nodes score 0."""
    if blast is None:
        return df.withColumn("blast_radius", F.lit(0.0))
    b = blast.select(F.col("node").alias("_blast_node"), F.col("blast_radius_score").alias("_blast"))
    j = df.join(b, df[node_col] == F.col("_blast_node"), "left")
    return j.withColumn("blast_radius", F.coalesce(F.col("_blast"), F.lit(0.0))).drop("_blast_node", "_blast")


def score_alerts(alerts: DataFrame, as_of: str | Column, blast: DataFrame | None = None,
                 model_p: Column | None = None, decoy_port_col: str | None = None,
                 top_features: list[str] | None = None) -> DataFrame:
    df = with_iocs(alerts, "raw_log", "processName")
    df = verify(df, as_of)
    df = df.withColumn("severity_raw", F.round(F.col("confidence_score") / 100.0, 4))
    df = TR.classify(df, model_p)
    df = TR.detect_decoys(df, decoy_port_col)
    df = TR.apply_decoy_override(df)
    df = attach_blast(df, blast)
    df = df.withColumn("playbook_actions", TR.service_playbook(F.col("severity"), F.col("source_ip"),
                                                               F.col("blast_radius"), F.col("timestamp")))
    df = df.withColumn("playbook_state", TR.final_state(F.col("playbook_actions")))
    top = F.lit((top_features or ["severity_raw"])[0])
    df = (df.withColumn("summary", TR.summary_template(F.col("severity"), F.col("event_type"), F.col("source_ip"),
                                                       F.col("confidence"), top))
            .withColumn("narrative", TR.narrative_template(F.col("playbook_actions"))))
    as_of_c = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")
    df = df.withColumn("_action_names", F.transform("playbook_actions", lambda a: a["action_taken"]))
    df = seal(df, field_payload(df, SEAL_FIELDS), captured_at=as_of_c).withColumnRenamed("sha256", "vault_hash")
    return df.drop("_action_names")


def response_shape(scored: DataFrame) -> DataFrame:
    """The scoring service's response columns with its null defaults."""
    s = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return scored.select(
        F.col("alert_id").cast("string").alias("alert_id"), F.col("severity"),
        F.coalesce(F.col("confidence"), F.lit(0.0)).cast("double").alias("confidence"),
        F.col("evidence_trail"),
        F.coalesce(F.col("blast_radius"), F.lit(0.0)).cast("double").alias("blast_radius"),
        F.coalesce(F.col("playbook_state"), F.lit("ALERT_RECEIVED")).alias("playbook_state"),
        F.col("summary"), F.col("narrative"), s("vault_hash").alias("vault_hash"),
        s("source_ip").alias("source_ip"), s("dest_ip").alias("dest_ip"),
        F.coalesce(F.col("port"), F.lit(0)).cast("int").alias("port"), s("event_type").alias("event_type"),
        F.coalesce(F.col("honeypot_triggered"), F.lit(False)).alias("honeypot_triggered"),
        s("triggered_asset_id").alias("triggered_asset_id"), s("protocol").alias("protocol"),
        s("accessed_path").alias("accessed_path"),
        F.coalesce(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias("timestamp"),
        F.col("verification_status"))

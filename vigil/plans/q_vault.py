"""Sealing and verification queries over scored alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.operators import listing as LS
from vigil.operators import vault as VT
from vigil.operators import vault_store as VS
from vigil.plans import oracle_sql as O
from vigil.plans.common import alerts
from vigil.plans.scoring import score_alerts
from vigil.session import materialize
from vigil.sources.testviews import AS_OF


def _sealed(spark, sf_dir) -> DataFrame:
    # Written once: the sealed table feeds three branches below.
    return materialize(score_alerts(alerts(spark, sf_dir), AS_OF).select(
        "snapshot_id", "alert_id", "event_id", "payload", "vault_hash", "captured_at"))


def vault_seal(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sealed(spark, sf_dir)
    return s.select("snapshot_id", "alert_id", F.col("vault_hash").alias("sha256"), F.length("vault_hash").alias("hash_len"))


def _stored_side(s: DataFrame):
    """Stored hashes as an archive would hold them: a few payloads were altered
    after sealing, a few payload files and a few hash files went missing."""
    eid = F.col("event_id")
    snaps = s.where(eid % 103 != 0).select(
        "snapshot_id", F.when(eid % 101 == 0, F.concat("payload", F.lit(" "))).otherwise(F.col("payload")).alias("payload"))
    stored = s.where(eid % 107 != 0).select("snapshot_id", F.col("vault_hash").alias("sha256"))
    return snaps, stored


def vault_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sealed(spark, sf_dir)
    snaps, stored = _stored_side(s)
    v = VT.verify_seals(snaps, stored)
    return v.groupBy("status").agg(F.count(F.lit(1)).alias("n_snapshots"),
                                   F.max(F.col("status") != "VERIFIED").alias("any_compromised"))


def custody_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sealed(spark, sf_dir)
    snaps, stored = _stored_side(s)
    v = VT.verify_seals(snaps, stored).join(s.select("snapshot_id", "alert_id", "captured_at"), "snapshot_id")
    return v.where(F.col("stored").isNotNull()).select(
        "snapshot_id", VT.custody_report(F.col("alert_id"), F.col("snapshot_id"), F.col("captured_at"),
                                         F.col("stored"), F.col("intact")).alias("report"))


def vault_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookups in the bucketed store: one for each alert, by an id that the store
    does not hold for every 50th; a few stored payloads were altered."""
    s = _sealed(spark, sf_dir)
    eid = F.col("event_id")
    name = VS.write_store(s.select("alert_id", "snapshot_id", F.col("vault_hash").alias("sha256"),
                                   F.when(eid % 101 == 0, F.concat("payload", F.lit(" "))).otherwise(F.col("payload")).alias("payload")))
    asked = s.select(F.when(eid % 50 == 0, F.concat("alert_id", F.lit("-gone"))).otherwise(F.col("alert_id")).alias("alert_id"))
    return VS.lookup_all(asked, name)


def vault_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole vault, newest event first, written as pages and read back."""
    from vigil.session import shared_path
    s = score_alerts(alerts(spark, sf_dir), AS_OF).select("snapshot_id", "alert_id", F.col("vault_hash").alias("sha256"), "timestamp")
    path = shared_path(spark, "vault-list")
    LS.write_pages(LS.ordered(s, LS.newest_first("timestamp", "snapshot_id")), path)
    return spark.read.parquet(f"{path}/pages").select("nth", "snapshot_id", "alert_id", "sha256")


QUERIES = {"vault_seal": vault_seal, "vault_verify": vault_verify, "custody_reports": custody_reports, "vault_lookup": vault_lookup, "vault_list": vault_list}

_PAY = O.SEALED_PAYLOAD
_SEALED = O.scored_ctes() + f""",
sl AS (SELECT alert_id, event_id, alert_id || '_2024-01-30T12-00-00_' || substr(sha256({_PAY}), 1, 8) AS snapshot_id, {_PAY} AS payload,
         sha256({_PAY}) AS vault_hash FROM scp),
snaps AS (SELECT snapshot_id, CASE WHEN event_id % 101 = 0 THEN payload || ' ' ELSE payload END AS payload FROM sl WHERE event_id % 103 <> 0),
stored AS (SELECT snapshot_id, vault_hash AS sha256 FROM sl WHERE event_id % 107 <> 0),
ver AS (SELECT coalesce(a.snapshot_id, b.snapshot_id) AS snapshot_id, sha256(a.payload) AS computed, b.sha256 AS stored
        FROM snaps a FULL OUTER JOIN stored b ON a.snapshot_id = b.snapshot_id),
vs2 AS (SELECT *, CASE WHEN computed IS NULL THEN 'MISSING_PAYLOAD' WHEN stored IS NULL THEN 'MISSING_HASH'
                       WHEN computed = stored THEN 'VERIFIED' ELSE 'TAMPERED' END AS status,
               coalesce(computed = stored, false) AS intact FROM ver)"""

ORACLE = {
    "vault_lookup": _SEALED + """,
req AS (SELECT CASE WHEN event_id % 50 = 0 THEN alert_id || '-gone' ELSE alert_id END AS alert_id FROM sl)
SELECT r.alert_id, sl.snapshot_id, sl.vault_hash AS sha256,
  CASE WHEN sl.alert_id IS NULL THEN 'NOT_FOUND' WHEN event_id % 101 = 0 THEN 'COMPROMISED' ELSE 'SECURE' END AS status
FROM req r LEFT JOIN sl ON sl.alert_id = r.alert_id""",
    "vault_list": O.scored_ctes() + f""",
sl AS (SELECT alert_id, "timestamp" AS ts, alert_id || '_2024-01-30T12-00-00_' || substr(sha256({_PAY}), 1, 8) AS snapshot_id, sha256({_PAY}) AS sha256 FROM scp)
SELECT row_number() OVER (ORDER BY ts DESC, snapshot_id) AS nth, snapshot_id, alert_id, sha256 FROM sl""",
    "vault_seal": _SEALED + "\nSELECT snapshot_id, alert_id, vault_hash AS sha256, CAST(length(vault_hash) AS INTEGER) AS hash_len FROM sl",
    "vault_verify": _SEALED + "\nSELECT status, count(*) AS n_snapshots, bool_or(status <> 'VERIFIED') AS any_compromised FROM vs2 GROUP BY 1",
    "custody_reports": _SEALED + """
SELECT v.snapshot_id, concat_ws(chr(10), '--- CHAIN OF CUSTODY REPORT ---', 'Incident ID: ' || sl.alert_id,
  'Snapshot ID: ' || v.snapshot_id, 'Capture Timestamp: 2024-01-30 12:00:00 UTC', 'SHA-256 Hash Seal: ' || v.stored,
  'System Hostname: SOC-NODE-01', 'Integrity: ' || CASE WHEN v.intact THEN 'VERIFIED' ELSE 'TAMPERED' END,
  '-------------------------------') AS report
FROM vs2 v JOIN sl ON sl.snapshot_id = v.snapshot_id WHERE v.stored IS NOT NULL""",
}

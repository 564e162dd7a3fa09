"""Sealing results with SHA-256 and verifying them later.

A snapshot is a deterministic payload string per row plus its ``sha2``.
Two payload forms: ``canonical_json`` (sorted keys, nulls kept) for storage,
and ``field_payload`` (length-prefixed fields) whose hash other engines can
recompute.  Verification recomputes and compares; stored files
are verified by hashing their bytes (``binaryFile``), never re-serialising.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def canonical_json(df: DataFrame, cols: list[str] | None = None) -> Column:
    cols = sorted(cols or df.columns)
    return F.to_json(F.struct(*[F.col(c) for c in cols]), {"ignoreNullFields": "false"})


def field_payload(df: DataFrame, cols: list[str]) -> Column:
    """Fields in the given order, each with its length in front and ``-`` for
    null, so that different rows never give one payload.  Lists are joined by
    commas, times are microseconds since the epoch."""
    def text(c: str) -> Column:
        kind = df.select(c).dtypes[0][1]
        if kind.startswith("array"):
            return F.array_join(c, ",")
        return (F.unix_micros(c) if kind == "timestamp" else F.col(c)).cast("string")

    def field(v: Column) -> Column:
        return F.coalesce(F.concat(F.length(v).cast("string"), F.lit(":"), v), F.lit("-"))
    return F.concat(*[field(text(c)) for c in cols])


def seal(df: DataFrame, payload: Column, id_col: str = "alert_id", captured_at: Column | None = None) -> DataFrame:
    """Add payload, sha256, captured_at and snapshot_id."""
    cap = captured_at if captured_at is not None else F.current_timestamp()
    out = (df.withColumn("payload", payload)
             .withColumn("sha256", F.sha2(F.col("payload"), 256))
             .withColumn("captured_at", cap))
    # alert id + capture time + payload digest: two snapshots of one alert
    # never collide, even within the same second
    return out.withColumn("snapshot_id", F.concat(F.col(id_col).cast("string"), F.lit("_"),
                                                  F.date_format("captured_at", "yyyy-MM-dd'T'HH-mm-ss"), F.lit("_"),
                                                  F.substring("sha256", 1, 8)))


def require_ids(df: DataFrame, id_col: str = "alert_id") -> tuple[DataFrame, DataFrame]:
    """(sealable rows, rejected rows without an id)."""
    ok = F.col(id_col).isNotNull()
    return df.where(ok), df.where(~ok)


def verify_seals(snapshots: DataFrame, stored: DataFrame, key: str = "snapshot_id") -> DataFrame:
    """Full outer join of recomputed and stored hashes.

    status: VERIFIED (equal), TAMPERED (differs), MISSING_PAYLOAD (hash only),
    MISSING_HASH (payload only)."""
    s = snapshots.select(F.col(key), F.sha2(F.col("payload"), 256).alias("computed"))
    t = stored.select(F.col(key), F.col("sha256").alias("stored"))
    j = s.join(t, key, "full_outer")
    status = (F.when(F.col("computed").isNull(), F.lit("MISSING_PAYLOAD"))
              .when(F.col("stored").isNull(), F.lit("MISSING_HASH"))
              .when(F.col("computed") == F.col("stored"), F.lit("VERIFIED"))
              .otherwise(F.lit("TAMPERED")))
    return j.withColumn("status", status).withColumn("intact", F.coalesce(F.col("computed") == F.col("stored"), F.lit(False)))


def scan_snapshot_dir(spark: SparkSession, path: str) -> DataFrame:
    """Stored snapshot files: one row per id with payload hash and stored hash.

    JSON and ``.sha256`` files are read as bytes; the id is parsed from the
    file name; the list status is COMPROMISED when the JSON file is missing."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "vault_*")
             .load(path).select("path", "content"))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    files = files.withColumn("name", name)
    js = (files.where(F.col("name").endswith(".json"))
               .select(F.regexp_extract("name", r"^vault_(.*)\.json$", 1).alias("snapshot_id"),
                       F.sha2(F.col("content"), 256).alias("computed")))
    hs = (files.where(F.col("name").endswith(".sha256"))
               .select(F.regexp_extract("name", r"^vault_(.*)\.sha256$", 1).alias("snapshot_id"),
                       F.trim(F.col("content").cast("string")).alias("stored")))
    j = hs.join(js, "snapshot_id", "full_outer")
    return j.select(
        "snapshot_id", "stored", "computed",
        F.element_at(F.split("snapshot_id", "_"), -1).alias("alert_id_suffix"),
        F.when(F.col("computed").isNull(), F.lit("COMPROMISED")).otherwise(F.lit("SECURE")).alias("list_status"),
        F.coalesce(F.col("computed") == F.col("stored"), F.lit(False)).alias("intact"))


def write_snapshots(df: DataFrame, path: str) -> None:
    """Append sealed rows to a parquet table partitioned by capture date."""
    (df.withColumn("capture_date", F.to_date("captured_at"))
       .write.mode("append").partitionBy("capture_date").parquet(path))


def custody_report(alert_id: Column, snapshot_id: Column, captured_at: Column, sha: Column,
                   intact: Column, host: str = "SOC-NODE-01") -> Column:
    return F.concat_ws("\n",
                       F.lit("--- CHAIN OF CUSTODY REPORT ---"),
                       F.concat(F.lit("Incident ID: "), alert_id),
                       F.concat(F.lit("Snapshot ID: "), snapshot_id),
                       F.concat(F.lit("Capture Timestamp: "), captured_at.cast("string"), F.lit(" UTC")),
                       F.concat(F.lit("SHA-256 Hash Seal: "), sha),
                       F.concat(F.lit("System Hostname: "), F.lit(host)),
                       F.concat(F.lit("Integrity: "), F.when(intact, F.lit("VERIFIED")).otherwise(F.lit("TAMPERED"))),
                       F.lit("-------------------------------"))

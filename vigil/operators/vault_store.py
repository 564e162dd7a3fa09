"""Snapshot store that is looked up by alert id.

Snapshots lie in a table bucketed and sorted by ``alert_id``.  A lookup of given ids
reads only their buckets; a table of requests is joined without moving the store.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.session import shared_path

BUCKET_ROWS = 250_000


def write_store(snapshots: DataFrame, buckets: int | None = None) -> str:
    """Writes sealed alerts to the shared folder; returns the table's name.
    The number of buckets follows the number of rows."""
    n = buckets or max(8, -(-snapshots.count() // BUCKET_ROWS))
    name = f"vigil_vault_{uuid.uuid4().hex[:12]}"
    (snapshots.repartition(n, "alert_id").write.option("path", shared_path(snapshots.sparkSession, "vault-store"))
     .bucketBy(n, "alert_id").sortBy("alert_id").saveAsTable(name))
    return name


def lookup(spark: SparkSession, name: str, alert_ids: list[str]) -> DataFrame:
    """The stored snapshots of a few alerts; only their buckets are read."""
    return spark.table(name).where(F.col("alert_id").isin(alert_ids))


def lookup_all(requests: DataFrame, name: str) -> DataFrame:
    """Every snapshot of each of ``requests(alert_id)``, checked against its hash;
    an id that the store does not hold has one row with status NOT_FOUND."""
    store = requests.sparkSession.table(name)
    found = requests.select("alert_id").distinct().join(store, "alert_id", "left")
    status = (F.when(F.col("snapshot_id").isNull(), F.lit("NOT_FOUND"))
              .when(F.sha2("payload", 256) == F.col("sha256"), F.lit("SECURE")).otherwise(F.lit("COMPROMISED")))
    return found.select("alert_id", "snapshot_id", "sha256", status.alias("status"))

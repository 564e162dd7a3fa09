"""Session construction and shared-storage helpers.

Everything in the library takes an existing ``SparkSession``; this module only
builds one for tests / the bench and resolves the shared folder used for
checkpoints and intermediate tables.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Session settings the library relies on.  Timestamps are always interpreted
# as UTC; AQE re-plans joins and coalesces shuffle partitions at run time and
# splits skewed join partitions.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "vigil", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", os.environ.get("VIGIL_DRIVER_MEMORY", "16g"))
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    On a cluster ``spark.checkpoint.dir`` names a shared (HDFS / object store)
    folder and is used as is.  Only when it is unset (local tests) a folder is
    created under the system temp directory and registered.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        configured = tempfile.mkdtemp(prefix="vigil-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/vigil-{name}-{uuid.uuid4().hex[:12]}"


def apply_session_defaults(spark: SparkSession) -> None:
    """Pin settings that results depend on (UTC) on a session we did not build."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def materialize(df):
    """Write ``df`` once to the shared checkpoint folder and cut its lineage.

    Used where one expensive derived table feeds several branches (or is
    filtered on derived columns, which the optimizer would otherwise push
    below the projection and evaluate twice).  Reliable checkpoints survive
    executor loss; ``localCheckpoint`` is never used."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)

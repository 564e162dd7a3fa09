"""Shared plan fragments for the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vigil.functions.ioc import with_iocs
from vigil.operators.verify import verify
from vigil.session import apply_session_defaults
from vigil.sources.tables import read_table
from vigil.sources.testviews import AS_OF, load_alerts


def table(spark: SparkSession, sf_dir: str, name: str, parallel: bool = False) -> DataFrame:
    apply_session_defaults(spark)
    return read_table(spark, sf_dir, name, parallel)


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    apply_session_defaults(spark)
    return load_alerts(spark, sf_dir)


def verified_alerts(spark: SparkSession, sf_dir: str, as_of: str = AS_OF) -> DataFrame:
    """alerts_v with indicators and the three verification passes."""
    a = with_iocs(alerts(spark, sf_dir), "raw_log", "processName")
    return verify(a, as_of)

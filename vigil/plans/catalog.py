"""Registered queries: (spark, sf_dir) -> DataFrame, with oracle SQL.

Queries are grouped by module; each module exposes ``QUERIES`` (name ->
callable) and ``ORACLE`` (name -> DuckDB SQL).  A name without an ORACLE
entry is checked on row counts only (non-SQL operators: model training,
streaming state).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from vigil.plans import q_alerts, q_extra, q_graph, q_ioc, q_ml, q_reports, q_sources, q_stream, q_triage, q_vault
    out: dict = {}
    for mod in (q_alerts, q_triage, q_ioc, q_reports, q_graph, q_vault, q_ml, q_stream, q_sources, q_extra):
        out.update(mod.QUERIES)
    return out


def all_oracles() -> dict[str, str]:
    from vigil.plans import q_alerts, q_extra, q_graph, q_ioc, q_ml, q_reports, q_sources, q_stream, q_triage, q_vault
    out: dict = {}
    for mod in (q_alerts, q_triage, q_ioc, q_reports, q_graph, q_vault, q_ml, q_stream, q_sources, q_extra):
        out.update(mod.ORACLE)
    return out

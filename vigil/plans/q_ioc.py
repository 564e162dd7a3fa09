"""Indicator extraction over the text tables (whole texts, one regex scan each)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions.ioc import with_ioc_struct
from vigil.plans import oracle_sql as O
from vigil.plans.common import alerts, table

LISTED = ["sha256", "md5", "cve", "url", "ipv6", "ipv4", "lateral_movement", "domain"]


def _indicators(df: DataFrame, id_col: str) -> DataFrame:
    x = with_ioc_struct(df, "text", out="ioc", fenced=True)
    any_kind = reduce(lambda a, b: a | b, [F.size(F.col("ioc")[k]) > 0 for k in LISTED])
    return x.where(any_kind).select(
        F.col(id_col), *[F.array_join(F.col("ioc")[k], ",").alias(k) for k in LISTED],
        (sum(F.when(F.size(F.col("ioc")[k]) > 0, 1).otherwise(0) for k in LISTED)).alias("n_kinds"))


def ioc_doc_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", parallel=True).select("doc_id", "text")
    return _indicators(docs, "doc_id")


def ioc_page_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", parallel=True).select(
        "page_id", F.concat_ws(" ", "url", "html").alias("text"))
    return _indicators(pages, "page_id")


def _text_sources(spark, sf_dir) -> DataFrame:
    parts = [
        table(spark, sf_dir, "documents").select(F.lit("documents").alias("source"), F.col("text")),
        table(spark, sf_dir, "pages").select(F.lit("pages").alias("source"), F.col("html").alias("text")),
        table(spark, sf_dir, "conversations").select(F.lit("conversations").alias("source"), F.col("text")),
        table(spark, sf_dir, "benchmark").select(F.lit("benchmark").alias("source"), F.col("text")),
    ]
    from vigil.sources.tables import ensure_parallel
    return ensure_parallel(reduce(DataFrame.unionByName, parts))


def ioc_kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source table and kind: values found and rows with at least one."""
    x = with_ioc_struct(_text_sources(spark, sf_dir), "text", out="ioc")
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.size(F.col("ioc")[k]).alias("n")) for k in LISTED])
    e = x.select("source", F.explode_outer(kinds).alias("k"))
    return (e.groupBy("source", F.col("k.kind").alias("kind"))
             .agg(F.sum("k.n").cast("bigint").alias("n_values"),
                  F.count(F.when(F.col("k.n") > 0, 1)).alias("n_rows")))


def ioc_alert_ports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Port indicators (look-behind pattern; no RE2 oracle) per alert."""
    x = with_ioc_struct(alerts(spark, sf_dir), "raw_log", out="ioc")
    return x.select("alert_id", F.array_join(F.col("ioc")["port"], ",").alias("ports"),
                    F.size(F.col("ioc")["port"]).alias("n_ports"))


QUERIES = {
    "ioc_doc_indicators": ioc_doc_indicators,
    "ioc_page_indicators": ioc_page_indicators,
    "ioc_kind_counts": ioc_kind_counts,
    "ioc_alert_ports": ioc_alert_ports,
}

_COLS = ("array_to_string(k_sha256, ',') AS sha256, array_to_string(k_md5, ',') AS md5, array_to_string(k_cve, ',') AS cve, "
         "array_to_string(k_url, ',') AS url, array_to_string(k_ipv6, ',') AS ipv6, array_to_string(k_ipv4, ',') AS ipv4, "
         "array_to_string(k_lateral, ',') AS lateral_movement, array_to_string(k_domain, ',') AS domain")
_NK = " + ".join(f"(CASE WHEN len(k_{k}) > 0 THEN 1 ELSE 0 END)" for k in
                 ["sha256", "md5", "cve", "url", "ipv6", "ipv4", "lateral", "domain"])
_KIND_COL = {"lateral_movement": "k_lateral"}

ORACLE = {
    "ioc_doc_indicators": "WITH " + O.ioc_cte("x", "documents", "text", keep="doc_id") +
    f"\nSELECT doc_id, {_COLS}, CAST({_NK} AS INTEGER) AS n_kinds FROM x WHERE {_NK} > 0",
    "ioc_page_indicators": "WITH src AS (SELECT page_id, concat_ws(' ', url, html) AS text FROM pages), " +
    O.ioc_cte("x", "src", "text", keep="page_id") +
    f"\nSELECT page_id, {_COLS}, CAST({_NK} AS INTEGER) AS n_kinds FROM x WHERE {_NK} > 0",
    "ioc_kind_counts": """WITH src AS (
  SELECT 'documents' AS source, text FROM documents UNION ALL SELECT 'pages', html FROM pages
  UNION ALL SELECT 'conversations', text FROM conversations UNION ALL SELECT 'benchmark', text FROM benchmark), """ +
    O.ioc_cte("x", "src", "text", keep="source") + ",\nu AS (" + " UNION ALL ".join(
        f"SELECT source, '{k}' AS kind, len({_KIND_COL.get(k, 'k_' + k)}) AS n FROM x" for k in LISTED) + """)
SELECT source, kind, CAST(sum(n) AS BIGINT) AS n_values, count(CASE WHEN n > 0 THEN 1 END) AS n_rows FROM u GROUP BY ALL""",
}

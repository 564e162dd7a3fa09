"""Alert verification queries over the alert view derived from ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.plans import oracle_sql as O
from vigil.plans.common import verified_alerts


def verify_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: indicators → three passes → status, grouped by (status, event)."""
    v = verified_alerts(spark, sf_dir)
    return (v.groupBy("verification_status", "event_type")
             .agg(F.count(F.lit(1)).alias("n_alerts"),
                  F.sum("confidence_score").cast("bigint").alias("sum_score"),
                  (F.sum("confidence_score") / F.count(F.lit(1))).alias("avg_score"),
                  F.sum("c1").cast("bigint").alias("sum_c1"),
                  F.sum("c2").cast("bigint").alias("sum_c2"),
                  F.sum("c3").cast("bigint").alias("sum_c3")))


QUERIES = {
    "verify_summary": verify_summary,
}

ORACLE = {
    "verify_summary": O.alerts_verified_ctes() + """
SELECT verification_status, event_type, count(*) AS n_alerts,
       CAST(sum(confidence_score) AS BIGINT) AS sum_score,
       sum(confidence_score) / count(*) AS avg_score,
       CAST(sum(c1) AS BIGINT) AS sum_c1, CAST(sum(c2) AS BIGINT) AS sum_c2, CAST(sum(c3) AS BIGINT) AS sum_c3
FROM vs GROUP BY ALL""",
}

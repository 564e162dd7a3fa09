"""Optimizer fence for expensive derived columns.

Catalyst pushes a filter below a projection by substituting the projected
expressions into the predicate.  When the projection holds an expensive
expression (a regex scan, a rule cascade), the pushed filter evaluates it a
second time, outside whole-stage codegen.  Passing the derived columns
through a one-element ``explode_outer`` puts a Generate node between them and
any later filter: predicates on generated columns are not pushed below it,
and projections are not collapsed across it.  Cost: one struct copy per row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fence(df: DataFrame, cols: list[str]) -> DataFrame:
    keep = [c for c in df.columns if c not in cols]
    packed = F.explode_outer(F.array(F.struct(*[F.col(c) for c in cols]))).alias("_fence")
    return df.select(*keep, packed).select(*keep, *[F.col(f"_fence.{c}").alias(c) for c in cols])

"""Text helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without leading and trailing white space of any kind (``trim`` takes blanks only)."""
    return F.regexp_replace(c.cast("string"), r"(?U)^\s+|\s+$", "")

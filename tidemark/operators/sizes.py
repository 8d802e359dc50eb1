"""Broadcasts behind a check of their size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ROWS = 10_000


def small(df: DataFrame, most: int = MAX_ROWS) -> DataFrame:
    """``df`` marked for broadcast when it has at most ``most`` rows, else unchanged, so that Spark shuffles it."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df

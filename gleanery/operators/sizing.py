"""The one place that decides whether a driver-known table may be broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast ``df`` when its known row count is small, else leave the join to Spark."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df

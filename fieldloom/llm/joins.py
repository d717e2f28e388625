"""Broadcasts behind a check of their size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a few numbers each that are sent to every executor at most; some tens of MB.
BROADCAST_ROWS = 500_000


def small_side(rows: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``rows`` (a written table) as the small side of a join: broadcast if they are ``most`` at most, else as Spark decides."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows

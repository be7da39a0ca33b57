"""Joins with tables that are usually small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a dictionary is sent to all executors; beyond it the join is left to the optimiser.
BROADCAST_ROWS = 50_000


def small(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The table, marked for broadcast if it has so many rows at most."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table

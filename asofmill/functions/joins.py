"""Choosing a join by the measured size of its small side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Reference data such as splits or instruments: a hundred thousand narrow rows are a few megabytes on each executor.
BROADCAST_ROWS = 100_000


def small_side(df: DataFrame, size_of: DataFrame | None = None, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast if a bounded count shows that it is small; otherwise leave it to a shuffled join,
    whose skewed partitions adaptive execution splits.

    ``size_of`` names a table with at least as many rows that is cheaper to count.
    """
    counted = (size_of if size_of is not None else df).limit(max_rows + 1).count()
    return F.broadcast(df) if counted <= max_rows else df

"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al., 2014).

Edges stay a table throughout; each step is written to the shared folder, so the lineage does not grow and a lost executor
costs a file read. A hub is a hot key of an aggregate with partial sums and of plain joins, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged


def _signature(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("big", "small").cast("decimal(38,0)"))).first()


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of a node point to the smallest of its neighbourhood."""
    ends = edges.select(F.col("big").alias("node"), F.col("small").alias("other")).unionAll(
        edges.select(F.col("small").alias("node"), F.col("small").alias("other")))
    # Written first: adaptive execution splits the hub of a join only where both sides come straight from a shuffle.
    least = staged(ends.groupBy("node").agg(F.min("other").alias("least")), "least")
    return edges.join(least, edges["small"] == least["node"]).select("big", F.col("least").alias("small")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours point to the smallest of them."""
    least = edges.groupBy("big").agg(F.min("small").alias("least"))
    moved = edges.join(least.withColumnRenamed("big", "node"), edges["big"] == F.col("node")).where(F.col("small") != F.col("least"))
    return least.select("big", F.col("least").alias("small")).unionAll(
        moved.select(F.col("small").alias("big"), F.col("least").alias("small"))).distinct()


def stars(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Edges (big, small) with big > small become (node, root): each node that is not the least of its component."""
    edges = staged(edges.select("big", "small").where("big > small").distinct(), "edges")
    before = _signature(edges)
    for _ in range(rounds):
        edges = staged(_small_star(_large_star(edges)), "edges")
        after = _signature(edges)
        if after == before:
            return edges.select(F.col("big").alias("node"), F.col("small").alias("root"))
        before = after
    raise RuntimeError(f"components did not settle in {rounds} rounds")

"""Nearest neighbours by a block matrix join: int8 product tiles with error bounds, exact cosine of what survives, heaps.

Queries and candidates are dealt into blocks and every query block meets every candidate block in one cell. In a cell vectors of
length one are coded as int8 with a scale each. The product of two codes is an exact integer (a float32 product of integers below
2^24, in slices of the dimensions), and the lengths of what the codes leave out bound how far it is from the cosine. Pairs whose
upper bound reaches the query's k-th best are computed again from the original vectors in double precision; a heap per query holds
the best. No pair that could belong to the result is lost, so recall is 1 by construction.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, neither as query nor as
candidate; vectors of different dimensions are no neighbours; a query is left out of its own candidates once, so a repeated row
finds its other copies; every query row has results of its own; equal scores go by ascending id, rows without id last; rows without
id are no queries; extra columns are ignored; an empty table gives an empty result.

Plan: blocks hold about ``QUERIES`` and ``CANDIDATES`` vector components, whatever the number of rows, so a task is bounded. A
candidate row is sent once per query block. Rows are dealt by their place in the input, so no id or vector makes a hot block. Of
candidates with equal vectors in a cell only the first ``k + 1`` ids are compared. A cell returns ``k + 1`` rows per query; they are
cut per group of cells before they meet per query.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged
from .embedding_dedup import usable

NEIGHBOURS = 5
#: Every so-manieth id is a query.
EVERY = 50
#: Components of the vectors of one block.
QUERIES = 1 << 18
CANDIDATES = 1 << 19
TILE = 1024
#: Sums of this many products of two int8 codes stay exact in float32.
DIMENSIONS = 1024


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision and in the order of the components: equal vectors give equal scores everywhere."""
    def product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.add.reduce(np.ascontiguousarray(x.T) * np.ascontiguousarray(y.T), axis=0)

    return product(a, b) / (np.sqrt(product(a, a)) * np.sqrt(product(b, b)))


class Codes:
    """int8 codes of vectors of length one, their scales, and the length of what each code leaves out."""

    def __init__(self, vectors: np.ndarray):
        unit = vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]
        self.scale = np.abs(unit).max(axis=1) / 127
        self.code = np.rint(unit / self.scale[:, None]).astype(np.int8)
        rest = unit - self.code * self.scale[:, None]
        self.error = np.sqrt(np.einsum("ij,ij->i", rest, rest)) + 1e-9

    def products(self, other: Codes, rows: slice) -> tuple[np.ndarray, np.ndarray]:
        """Approximate cosines with ``rows`` of the other side, and how far they may be off."""
        total = np.zeros((len(self.code), len(other.code[rows])))
        for low in range(0, self.code.shape[1], DIMENSIONS):
            part = slice(low, low + DIMENSIONS)
            total += self.code[:, part].astype(np.float32) @ other.code[rows, part].astype(np.float32).T
        error = other.error[rows]
        return total * self.scale[:, None] * other.scale[rows], self.error[:, None] * (1 + error) + error


def _first_copies(vectors: np.ndarray, ids: np.ndarray, none: np.ndarray, most: int) -> np.ndarray:
    """Positions without those that ``most`` equal vectors with smaller ids go before."""
    _, group = np.unique(np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel(), return_inverse=True)
    order = np.lexsort((ids, none, group))
    ordered = group[order]
    return np.sort(order[np.arange(len(order)) - np.searchsorted(ordered, ordered) < most])


def nearest_in(queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray, none: np.ndarray, most: int) -> Iterator[tuple[int, float, bool, int, int]]:
    """(query, score, has id, id, position) of the ``most`` best candidates of each query: high score, then small id."""
    heaps: list[list] = [[] for _ in range(len(queries))]
    # Scaled by powers of two, which changes no cosine but keeps squares within the range of doubles.
    queries, vectors = (np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None]) for x in (queries, vectors))
    own, other = Codes(queries), Codes(vectors)
    floor = np.full(len(queries), -np.inf)
    for start in range(0, len(vectors), TILE):
        rows = slice(start, start + TILE)
        near, off = own.products(other, rows)
        if near.shape[1] >= most:
            floor = np.maximum(floor, np.partition(near - off, near.shape[1] - most, axis=1)[:, near.shape[1] - most] - 1e-12)
        q, c = np.nonzero(near + off >= floor[:, None])
        c += start
        for low in range(0, len(q), 65_536):
            i, j = q[low:low + 65_536], c[low:low + 65_536]
            scores = cosines(queries[i], vectors[j])
            good = scores >= floor[i]
            for n, m, score in zip(i[good].tolist(), j[good].tolist(), scores[good].tolist()):
                row = (score, not none[m], -int(ids[m]), m)
                if len(heaps[n]) < most:
                    heapq.heappush(heaps[n], row)
                elif row > heaps[n][0]:
                    heapq.heappushpop(heaps[n], row)
            full = [n for n in np.unique(i[good]).tolist() if len(heaps[n]) == most]
            floor[full] = np.maximum(floor[full], [heaps[n][0][0] for n in full])
    for n, heap in enumerate(heaps):
        for score, has, minus, m in heap:
            yield n, score, has, -minus, m


FOUND = "q long, query_id long, id long, none boolean, score double, same boolean"


def _cell(most: int):
    def run(cell: pd.DataFrame) -> pd.DataFrame:
        asked = cell["q"].notna().to_numpy()
        if asked.all() or not asked.any():
            return pd.DataFrame({"q": [], "query_id": [], "id": [], "none": [], "score": [], "same": []})
        queries, rest = cell[asked], cell[~asked]
        a, b = (np.stack(part["vector"].to_numpy()).astype(np.float64) for part in (queries, rest))
        ids, none = rest["id"].fillna(0).to_numpy(np.int64), rest["id"].isna().to_numpy()
        kept = _first_copies(b, ids, none, most)
        b, ids, none = b[kept] + 0.0, ids[kept], none[kept]
        number, name = queries["q"].to_numpy(np.int64), queries["id"].to_numpy(np.int64)
        rows = [(number[n], name[n], i, not has, score, has and i == name[n] and np.array_equal(a[n], b[m]))
                for n, score, has, i, m in nearest_in(a, b, ids, none, most)]
        return pd.DataFrame(rows, columns=["q", "query_id", "id", "none", "score", "same"])

    return run


def nearest_neighbours(vectors: DataFrame, k: int = NEIGHBOURS, every: int = EVERY, id_col: str = "vec_id", vector_col: str = "embedding",
                       query_values: int = QUERIES, candidate_values: int = CANDIDATES, group: int = 64) -> DataFrame:
    """One row per query and neighbour: query_id, rank, vec_id, score."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    good = rows.where(usable(F.col("vector"))).withColumn("width", F.size("vector"))
    asked = staged(good.where(F.col("id") % every == 0).withColumn("q", F.monotonically_increasing_id()), "search-queries")
    # Counting the components reads the vectors once more, but no row leaves its task.
    parts = [max(1, -(-(side.agg(F.sum("width").alias("n")).first().n or 0) // most)) for side, most in ((asked, query_values), (good, candidate_values))]
    blocks = [F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in parts]
    queries = asked.withColumn("query_block", F.pmod("q", F.lit(parts[0])).cast("int")).withColumn("block", blocks[1])
    candidates = good.withColumn("q", F.lit(None).cast("long")).withColumn("block", F.pmod(F.monotonically_increasing_id(), F.lit(parts[1])).cast("int")).withColumn(
        "query_block", blocks[0])
    columns = ["width", "query_block", "block", "q", "id", "vector"]
    found = queries.select(*columns).unionAll(candidates.select(*columns)).groupBy("width", "query_block", "block").applyInPandas(_cell(k + 1), FOUND)
    order = [F.desc("score"), F.asc("none"), F.asc("id")]
    found = staged(found.withColumn("group", F.floor(F.spark_partition_id() / group)), "search-found")
    # The query itself is among its candidates once; of equal rows any is it.
    itself = Window.partitionBy("q", "same").orderBy("id")
    for keys in (["q", "group"], ["q"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k + 1)
    others = found.withColumn("copy", F.row_number().over(itself)).where(~F.col("same") | (F.col("copy") > 1))
    final = others.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("rank") <= k)
    return final.select("query_id", F.col("rank").cast("int"), F.when(~F.col("none"), F.col("id")).alias("vec_id"), "score")

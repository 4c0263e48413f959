"""Embedding near-duplicates by product quantisation: coarse inverted lists with residual subspace codes, asymmetric distances by
table lookup over the probed lists, exact cosine of what remains.

Each distinct vector lives in the list of its nearest centre and visits the ``PROBES`` lists nearest to it. In a list the visitor
stays as it is, the residents are codes: their product with the visitor is the product with the centre plus one table entry per
subspace. The length of what a code leaves out and the angle by which it is off bound the error of that product, so no pair of the
list that could reach the threshold is lost before the exact cosine in double precision decides. A pair is lost only if neither
visits the other's list.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of different
dimensions do not link; identical vectors are linked; a null id takes part but never names a component while one of its vectors
has an id, and counts as kept where the component has no id; repeated rows are linked vectors; extra columns are ignored; an empty
table gives an empty result.

Plan: identical vectors become one row with a count. Centres and codes are fitted on at most about ``SAMPLE`` vectors; every vector
is indexed. The lists of a vector are found once and written; Spark explodes them into visits, and only these carry the vector
again. Lists of over ``CELL`` residents or visitors are cut into cells, so a task holds at most that many of each. A pair is
credited in one cell only (``_credited``); a cell returns counts and a spanning star per connected set, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .components import stars
from .quantiser import Quantiser, nearest, unit
from .vptree import Forest

THRESHOLD = 0.9
PROBES = 12
SAMPLE = 32_768
LIST = 256
LISTS = 4096
CELL = 16_384
#: Visitors and residents looked up at a time: a block stays in a core's cache.
TILE = 128
RESIDENTS = 1024
#: Times dimensions plus twenty: what single precision can lose of a looked-up product. All its terms together are less than eight.
SINGLE = 8 * 2.0**-24


def usable(vector: Column) -> Column:
    """No null, non-finite or all-zero vector.

    Spark orders NaN above every number. A search for what is not there gives null where an element is null.
    """
    low, high, no_null = F.array_min(vector), F.array_max(vector), ~F.array_contains(vector, F.lit(float("nan")).cast("float"))
    return F.coalesce((low > float("-inf")) & (high < float("inf")) & ((low < 0) | (high > 0)) & no_null, F.lit(False))


def _probed(units: DataFrame, model, probes: int) -> DataFrame:
    """``units`` and ``near``, the lists nearest to each vector, nearest first: its own and the others it visits."""

    @F.pandas_udf("array<int>")
    def near(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        centres = model.value.centres
        for batch in batches:
            yield pd.Series(list(nearest(unit(np.stack(batch)), centres, min(probes, len(centres))) if len(batch) else []))

    return units.withColumn("near", near("vector"))


def _cuts(probed: DataFrame, cell: int) -> DataFrame:
    """(list, across, down) of the lists that are cut: into how many parts go their residents and their visitors."""
    sizes = probed.select(F.posexplode("near").alias("pos", "list")).groupBy("list").agg(
        F.count_if(F.col("pos") == 0).alias("own"), F.count(F.lit(1)).alias("n"))
    return sizes.where(F.col("n") > cell).select(
        "list", F.greatest(F.lit(1), F.ceil(F.col("own") / cell)).alias("across"), F.ceil(F.col("n") / cell).alias("down"))


def _visits(probed: DataFrame, cuts: DataFrame) -> DataFrame:
    """(cell, rid, copies, vector, home, near, here, guest): a vector in the cells of its own list and of those it visits.

    A cell is a part of a list's residents by a part of its visitors; a resident is in the cells of one row, a visitor in those of
    one column. Only residents bring ``near``.
    """
    part = F.xxhash64("rid")
    visits = probed.select("rid", "copies", "vector", "near", F.posexplode("near").alias("pos", "list")).join(F.broadcast(cuts), "list", "left")
    down, resident = F.coalesce("down", F.lit(1)), F.col("pos") == 0
    visits = visits.withColumns({"row": F.coalesce(F.pmod(part, "across"), F.lit(0)), "column": F.coalesce(F.pmod(part, "down"), F.lit(0))})
    as_guest = F.sequence("column", F.col("column") + (F.col("across") - 1) * down, down)
    as_resident = F.when(resident, F.sequence(F.col("row") * down, F.col("row") * down + down - 1)).otherwise(F.array())
    parts = F.when(F.col("down").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.array_union(as_guest, as_resident))
    return visits.withColumn("part", F.explode(parts)).select(
        (F.shiftleft(F.col("list").cast("long"), 32) + F.col("part")).alias("cell"), "rid", "copies", "vector", F.col("near")[0].alias("home"),
        F.when(resident, F.col("near")).alias("near"), (resident & (F.floor(F.col("part") / down) == F.col("row"))).alias("here"),
        (F.col("part") % down == F.col("column")).alias("guest"))


def _credited(own_rid, own_probes, guest_rid, guest_list) -> np.ndarray:
    """Which resident (row) and visitor (column) are credited here: the smaller id is the resident, or its list does not see the other.

    The pair of a smaller visitor and a larger resident also meets in the visitor's list if the resident visits that list.
    """
    seen = np.zeros((len(own_rid), len(guest_rid)), dtype=bool)
    for probe in own_probes.T:
        seen |= probe[:, None] == guest_list
    return (own_rid[:, None] < guest_rid) | ~seen


def _linked(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of both have a cosine of at least the threshold; close to it the sum is taken pair by pair, so all cells agree."""
    cosine = a @ b.T
    i, j = np.nonzero(np.abs(cosine - threshold) < 1e-12)
    cosine[i, j] = np.einsum("ij,ij->i", a[i], b[j])
    return cosine >= threshold


def _matrix(lists: pa.ChunkedArray, width: int) -> np.ndarray:
    """The lists that are not null as rows of a matrix; all have the same length."""
    return lists.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _cell(model, threshold: float, most: int):
    def run(key: tuple[pa.Scalar], cell: pa.Table) -> pa.Table:
        quantiser, one = model.value, key[0].as_py() >> 32
        cell = cell.take(pc.sort_indices(cell["rid"]))
        rid, copies, lists, here, guest = (cell[name].to_numpy() for name in ("rid", "copies", "home", "here", "guest"))
        rows = unit(_matrix(cell["vector"], quantiser.centres.shape[1]))
        own, guests = np.nonzero(here)[0], np.nonzero(guest)[0]
        probes = np.full((len(rows), min(most, len(quantiser.centres))), -1)
        probes[~cell["near"].is_null().to_numpy()] = _matrix(cell["near"], probes.shape[1])
        forest, links = Forest(len(rows)), np.zeros(len(rows), dtype=np.int64)
        if len(own):
            codes, least = quantiser.encode(rows[own], one, threshold)
            slack = SINGLE * (rows.shape[1] + 20)
            for low in range(0, len(guests), TILE):
                part = guests[low:low + TILE]
                centre, tables = rows[part] @ quantiser.centres[one], quantiser.tables(rows[part])
                for first in range(0, len(own), RESIDENTS):
                    some = slice(first, first + RESIDENTS)
                    # A row per resident, so each table is read in whole rows.
                    over = (centre - least[some, None]).astype(np.float32)
                    for table, code in zip(tables, codes[some].T):
                        over += table.take(code, axis=0)
                    hit = over >= -slack
                    r, g = own[some][hit.any(axis=1)], part[hit.any(axis=0)]
                    near = _linked(rows[r], rows[g], threshold) & (r[:, None] != g)
                    i, j = np.nonzero(near & (forest.parent[r][:, None] != forest.parent[g]))
                    forest.join(r[i], g[j])
                    credited = near & _credited(rid[r], probes[r], rid[g], lists[g])
                    links[r] += credited @ copies[g]
                    links[g] += copies[r] @ credited
        at = np.nonzero((forest.parent != np.arange(len(rows))) | (links > 0))[0]
        return pa.table({"rid": rid[at], "links": links[at], "root": rid[forest.parent[at]]})

    return run


def _linked_units(units: DataFrame, count: int, threshold: float, probes: int, sample: int, per_list: int, cell: int) -> DataFrame:
    """(rid, links, root) partial rows of the ``count`` units of one dimension."""
    share = F.pmod(F.xxhash64("rid"), F.lit(1 << 20)) < max(1, min(1 << 20, (sample << 20) // max(1, count)))
    drawn = units.where(share).select("rid", "vector").toPandas().sort_values("rid")
    if not len(drawn):
        drawn = units.select("rid", "vector").limit(1).toPandas()
    lists = max(1, min(LISTS, count // per_list, len(drawn) // 8))
    model = units.sparkSession.sparkContext.broadcast(Quantiser.train(unit(np.stack(drawn["vector"].to_numpy())), lists))
    # Written first: both the sizes of the lists and the visits read it.
    probed = staged(_probed(units.select("rid", "copies", "vector"), model, probes), "vector-probes")
    return _visits(probed, _cuts(probed, cell)).groupBy("cell").applyInArrow(_cell(model, threshold, probes), "rid long, links long, root long")


def embedding_links(vectors: DataFrame, threshold: float = THRESHOLD, probes: int = PROBES, sample: int = SAMPLE, per_list: int = LIST,
                    cell: int = CELL, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    # Vectors of floats stay floats until they are compared: half the bytes of every shuffle, the same numbers.
    kind = "array<float>" if vectors.select(vector_col).dtypes[0][1] == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("vector"))
    good = rows.where(usable(F.col("vector")))
    units = staged(good.groupBy("vector").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies")).withColumn(
        "rid", F.monotonically_increasing_id()).withColumn("width", F.size("vector")), "vectors")
    parts = None
    for r in units.groupBy("width").count().collect():
        part = _linked_units(units.where(F.col("width") == r["width"]), r["count"], threshold, probes, sample, per_list, cell)
        parts = part if parts is None else parts.unionAll(part)
    if parts is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    parts = staged(parts, "vector-links")
    roots = stars(parts.select(F.col("rid").alias("big"), F.col("root").alias("small")))
    links = parts.groupBy("rid").agg(F.sum("links").alias("links"))
    placed = units.select("rid", "least", "copies").join(roots, units["rid"] == roots["node"], "left").withColumn(
        "root", F.coalesce("root", "rid")).drop("node")
    named = staged(placed.groupBy("root").agg(F.min("least").alias("component_id")), "vector-components")
    facts = staged(placed.join(named, "root").join(links, "rid", "left").select(
        "rid", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "vector-facts")
    # Rows meet their unit by the hash first, which sorts fast; the vectors decide. Facts follow by number, so no vector goes with them.
    # A vector that is not usable equals no unit's.
    keyed = [df.select(name, "vector", F.xxhash64("vector").alias("hash")) for df, name in ((rows, "vec_id"), (units, "rid"))]
    numbered = keyed[0].join(keyed[1], ["hash", "vector"], "left").select("vec_id", "rid")
    return numbered.join(facts, "rid", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("rid").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id")).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

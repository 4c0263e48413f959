"""SimHash near-duplicates: fingerprints, vantage-point shards, exact links, connected components.

Words are runs of anything but white space in the text with A-Z in lower case; a shingle is four words joined by a blank
(shorter texts: all words). A bit of the fingerprint is set when it is set in over half of the shingles' XXH64 values (seed
42), repeats included. Fingerprints that differ in at most four bits are linked.

Defined results: null and wordless texts have the fingerprint zero and are linked like any other; rows without id take part
but never name a component while one of its rows has an id; repeated rows share fingerprint and component; extra columns are
ignored; an empty table gives an empty result.

Plan: texts are read once, only ids and fingerprints are written. Copies collapse to one row per fingerprint before anything
is compared. A sample of at most about ``SAMPLE`` fingerprints places the vantage points; every fingerprint is then dealt to
its home leaf and to the leaves its radius overlaps. Leaves beyond ``CELL`` rows are cut into cells of homes and visitors, so
a task never holds more than twice ``CELL`` rows. A cell returns a spanning star per connected set, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .components import stars
from .rows import keep_rows, row_key, text_or_empty
from .vptree import Tree, linked, masks

WORDS = 4
DISTANCE = 4
BLOCKS = 3
SAMPLE = 16_384
LEAF = 16_384
CELL = 65_536


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The fingerprint as an unsigned number. UTF-8 bytes: lower() and split() then touch A-Z and ASCII blanks only."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    line = b" ".join(parts)
    count = len(parts) - words + 1
    if count <= 1:
        return xxhash.xxh64_intdigest(line, 42)
    ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest

    def chunks() -> Iterator[list[int]]:
        for low in range(0, count, 65_536):  # bounds memory for very long texts
            high = min(count, low + 65_536)
            yield [digest(line[a:b], 42) for a, b in zip(starts[low:high].tolist(), ends[low + words - 1:high + words - 1].tolist())]

    return majority(chunks(), count)


def majority(chunks: Iterable, count: int) -> int:
    """The bits that are set in over half of ``count`` 64-bit values, which come in chunks."""
    total = np.zeros(64, dtype=np.int64)
    for hashes in chunks:
        bits = np.unpackbits(np.asarray(hashes, dtype=">u8").view(np.uint8)).reshape(-1, 64)
        full = len(bits) // 255 * 255  # sums of 255 bits fit a byte
        total += bits[:full].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        total += bits[full:].sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > count).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """id, x (row key), fp as a signed 64-bit number; written once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = np.array([fingerprint(t, words) for t in batch.pop("text")], dtype=np.uint64)
            yield batch.assign(fp=values.view(np.int64))

    source = docs.select(F.col(id_col).cast("long").alias("id"), row_key(text_col).alias("x"), text_or_empty(text_col).alias("text"))
    return staged(source.mapInPandas(run, "id long, x long, fp long"), "fingerprints")


def _dealt(distinct: DataFrame, trees: list[Tree], reach: int, chunks: dict | None) -> DataFrame:
    """(cell, fp, home): each fingerprint in its home leaf and in the leaves it visits.

    ``chunks`` maps a leaf to its numbers of home and visitor chunks; leaves that are not in it are one cell.
    """
    offsets = np.concatenate(([0], np.cumsum([t.leaves for t in trees])))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = batch["fp"].to_numpy(dtype=np.int64)
            bits = values.view(np.uint64)
            for tree, offset in zip(trees, offsets):
                lives = np.empty(len(bits), dtype=np.int64)
                for leaf, at in tree.route(bits, 0):
                    lives[at] = leaf
                for leaf, at in tree.route(bits, reach):
                    own, home = values[at], lives[at] == leaf
                    across, down = (chunks or {}).get(int(leaf + offset), (1, 1))
                    mixed = (own.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                    a, b = (mixed % np.uint64(across)).astype(np.int64), (mixed % np.uint64(down)).astype(np.int64)
                    base = (int(leaf + offset) << 24)
                    for i in range(across):
                        # A home stands in every visitor chunk of its row, a visitor in every home chunk of its column.
                        for j in range(down):
                            here_home, here_guest = home & (a == i), b == j
                            here = here_home | here_guest
                            if here.any():
                                yield pd.DataFrame({"cell": base + i * down + j, "fp": own[here], "home": here_home[here]})

    return distinct.select("fp").mapInPandas(run, "cell long, fp long, home boolean")


def _cell_links(trees: list[Tree], reach: int, distance: int):
    offsets = np.cumsum([t.leaves for t in trees])

    def run(cell: pd.DataFrame) -> pd.DataFrame:
        leaf = int(cell["cell"].iloc[0]) >> 24
        tree = trees[int(np.searchsorted(offsets, leaf, side="right"))]
        order = np.argsort(cell["fp"].to_numpy(), kind="stable")
        values, home = cell["fp"].to_numpy()[order], cell["home"].to_numpy()[order]
        root = linked(values.view(np.uint64), home, tree.mask, reach, distance)
        at = np.nonzero(root != np.arange(len(root)))[0]
        return pd.DataFrame({"big": values[at], "small": values[root[at]]})

    return run


def links(distinct: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, sample: int = SAMPLE, leaf: int = LEAF,
          cell: int = CELL) -> DataFrame:
    """Edges (big, small) between distinct fingerprints that connect exactly what links of at most ``distance`` bits connect."""
    count = distinct.count()
    # The sample only places the vantage points.
    share = F.pmod(F.xxhash64("fp"), F.lit(1 << 20)) < max(1, min(1 << 20, (sample << 20) // max(1, count)))
    drawn = np.sort(np.array([r.fp for r in distinct.where(share).select("fp").collect()], dtype=np.int64)).view(np.uint64)
    depth = max(0, int(np.ceil(np.log2(max(1, count / leaf)))))
    trees, reach = [Tree.build(drawn, mask, depth) for mask in masks(blocks)], distance // blocks
    sizes = _dealt(distinct, trees, reach, None).groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("home").cast("int")).alias("homes")).where(F.col("n") > cell).collect()
    chunks = {r.cell >> 24: (-(-r.homes // cell), -(-r.n // cell)) for r in sizes}
    return _dealt(distinct, trees, reach, chunks).groupBy("cell").applyInPandas(
        _cell_links(trees, reach, distance), "big long, small long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                   distance: int = DISTANCE, **tree) -> DataFrame:
    """One row per document: id, x, fp, root (least fingerprint of the component), component_id."""
    prints = fingerprints(docs, id_col, text_col, words)
    distinct = staged(prints.groupBy("fp").agg(F.min("id").alias("least")), "distinct-fingerprints")
    found = stars(links(distinct, distance, **tree))
    # Only fingerprints with a link need the way over their root.
    member = found.unionAll(found.select(F.col("root").alias("node"), "root").distinct())
    placed = distinct.join(member, distinct["fp"] == member["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"), F.col("root").isNotNull().alias("has_link"))
    named = staged(placed.where("has_link").groupBy("root").agg(F.min("least").alias("component")), "component-names")
    of_fp = placed.join(named.withColumnRenamed("root", "named_root"), placed["root"] == F.col("named_root"), "left").select(
        F.col("fp").alias("own_fp"), "root", F.when(F.col("has_link"), F.col("component")).otherwise(F.col("least")).alias("component_id"))
    return prints.join(of_fp, prints["fp"] == of_fp["own_fp"]).drop("own_fp")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                       distance: int = DISTANCE, **tree) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    return simhash_groups(docs, id_col, text_col, words, distance, **tree).select(
        F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                     distance: int = DISTANCE, **tree) -> DataFrame:
    """One document of each component stays, with all its columns: the one with the smallest id."""
    groups = staged(simhash_groups(docs, id_col, text_col, words, distance, **tree), "near-groups")
    first = groups.where(F.col("id").eqNullSafe(F.col("component_id")))
    # Rows of one component that share the id: the least row key stays.
    kept = first.groupBy("root").agg(F.min("x").alias("x"), F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    return keep_rows(docs, kept, not kept.where("n > 1").isEmpty(), id_col, text_col)

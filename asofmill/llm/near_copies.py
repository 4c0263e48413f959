"""Near copies by similarity: of texts linked by equal shingles one stays.

Words and white space are those of ``simhash``; a shingle is five words joined by a blank (shorter texts: all words). Two texts
are linked when shared shingles are at least ``SIMILARITY`` of all shingles of both, repeats counted once. The links are
followed through whole components.

Defined results: texts without words are equal to each other and to nothing else; rows without id take part but never stay while a
row of the component has an id; of rows that share id and text one stays; an empty table gives an empty result.

Plan: texts with equal shingles collapse to one row. Texts whose SimHash fingerprints over these shingles are connected by the
vantage-point trees of ``simhash`` (at most ``DISTANCE`` bits) make one bucket. Similarity 0.8 lets many more bits differ than a tree can
reach, so texts also meet by ``BANDS`` keys of ``ROWS`` least hashes: a pair at similarity 0.8 has none in common with probability
(1 - 0.8^4)^26, about one in a million, and less above. Buckets of either kind only say who meets; links are decided exactly. The least
text of a bucket is its vantage point: every other text of its buckets gets its exact distance (one minus similarity, a metric) to it,
and texts within the bound are linked. Distances deal the rest into rings as wide as the bound; by the triangle inequality a link joins texts
of one ring or of neighbouring rings. Only texts that are not yet connected with their vantage point look further, and only there.
Both steps run in cells of bounded size: links join sets as they are found, a cell returns spanning edges, pairs are never listed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .components import stars
from .rows import keep_rows, row_key, text_or_empty
from .simhash import DISTANCE, links, majority
from .vptree import Forest

WORDS = 5
#: As a fraction, so that a pair at the bound is decided in whole numbers.
SIMILARITY = (4, 5)
BANDS = 26
ROWS = 4
#: Shingles of the texts of one side of a cell, about.
CELL = 1 << 19
_MIX = np.random.default_rng(5).integers(0, 1 << 64, (2, BANDS * ROWS), dtype=np.uint64)
_FACTOR, _OFFSET = _MIX[0] | np.uint64(1), _MIX[1]


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """XXH64 values of the distinct shingles, in order."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.empty(0, dtype=np.uint64)
    line = b" ".join(parts)
    count = max(1, len(parts) - words + 1)
    ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:count]
    ends = ends[min(words, len(parts)) - 1:]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(line[a:b]) for a, b in zip(starts.tolist(), ends.tolist())), dtype=np.uint64, count=count))


def fingerprint(hashes: np.ndarray) -> int:
    """The SimHash of the distinct shingles as a signed 64-bit number; zero without any."""
    if not len(hashes):
        return 0
    value = majority([hashes[low:low + 65_536] for low in range(0, len(hashes), 65_536)], len(hashes))
    return int(np.uint64(value).view(np.int64))


def band_keys(hashes: np.ndarray) -> list[int]:
    """Signed 64-bit keys; texts with equal least hashes in a band share its key."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for low in range(0, len(hashes), 2048):  # bounds memory for very long texts
        part = (hashes[low:low + 2048, None] ^ _OFFSET) * _FACTOR
        np.minimum(least, (part ^ (part >> np.uint64(31))).min(axis=0), out=least)
    bands = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), n) for n, b in enumerate(bands)], dtype=np.uint64).view(np.int64).tolist()


def _prints(docs: DataFrame, words: int) -> DataFrame:
    """id, x, the 128-bit digest of the shingles, their number, fingerprint, band keys."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for text in batch.pop("text"):
                hashes = shingles(text, words)
                whole = xxhash.xxh3_128_digest(hashes.tobytes())
                found.append((*np.frombuffer(whole, dtype=np.int64).tolist(), len(hashes), fingerprint(hashes), band_keys(hashes)))
            names = ("high", "low", "size", "fp", "keys")
            yield batch.assign(**dict(zip(names, map(list, zip(*found))))) if found else batch.assign(**{name: [] for name in names})

    return staged(docs.mapInPandas(run, "id long, x long, high long, low long, size int, fp long, keys array<long>"), "shingle-prints")


def _near_fingerprints(sets: DataFrame, distance: int) -> DataFrame:
    """(n, size, key): texts whose fingerprints are connected share a key. Texts without words are one set already."""
    worded = sets.where("size > 0").select("n", "size", "fp")
    found = stars(links(staged(worded.select("fp").distinct(), "distinct-fingerprints"), distance))
    return staged(worded.join(found, F.col("fp") == F.col("node"), "left").select("n", "size", F.coalesce("root", "fp").alias("key")), "fingerprint-keys")


def _grams(rows: DataFrame, words: int) -> DataFrame:
    """(n, text) become (n, grams)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for low in range(0, len(batch), 256):  # the arrays are larger than the texts
                part = batch.iloc[low:low + 256]
                yield pd.DataFrame({"n": part["n"], "grams": [shingles(t, words).view(np.int64) for t in part["text"]]})

    return rows.mapInPandas(run, "n long, grams array<long>")


def _all_grams(sets: DataFrame, needed: DataFrame, source: DataFrame, words: int) -> DataFrame:
    """(n, grams) of the sets that ``needed`` names; written once."""
    wanted = sets.join(needed, "n", "left_semi").select("n", F.col("least.id").alias("want_id"), F.col("least.x").alias("want_x"))
    texts = source.join(wanted, (source["x"] == F.col("want_x")) & source["id"].eqNullSafe(F.col("want_id"))).select("n", "text")
    # Rows that share id and text come more than once.
    return staged(_grams(texts, words).dropDuplicates(["n"]), "grams")


def _dealt(entries: DataFrame, grams: DataFrame, cell: int) -> DataFrame:
    """Rows of the entries (ball, n, size, home, guest, ...) with their grams and the cell (low, part) in which they meet.

    A ball is a set of homes and guests that are to be compared. Small balls share cells; large ones become a grid of chunks, in
    which a home stands in every guest chunk of its row and a guest in every home chunk of its column.
    """
    total = [F.sum(F.when(F.col(side), F.col("size").cast("long"))).alias(f"{side}_size") for side in ("home", "guest")]
    sizes = entries.groupBy("ball").agg(*total)
    chunks = [F.ceil(F.coalesce(f"{side}_size", F.lit(0)) / cell).cast("int").alias(f"{side}_chunks") for side in ("home", "guest")]
    # Written first: adaptive execution splits a large ball of a join only where both sides come straight from a shuffle.
    large = staged(sizes.select(F.col("ball").alias("large"), *chunks).where("home_chunks > 1 OR guest_chunks > 1"), "large-balls")
    groups = max(1, (entries.agg(F.sum("size")).first()[0] or 0) // cell)
    placed = entries.join(large, F.col("ball") == F.col("large"), "left")
    one = F.array(F.struct(F.pmod(F.xxhash64("ball"), F.lit(groups)).alias("low"), F.lit(-1).alias("part")))

    def along(side: str, other: str, at) -> Column:
        """Places of a row in its own chunk of one side and all chunks of the other."""
        own = F.pmod(F.xxhash64("n"), F.greatest(F.lit(1), f"{side}_chunks")).cast("int")
        every = F.sequence(F.lit(0), F.greatest(F.lit(1), f"{other}_chunks") - 1)
        return F.when(F.col(side), F.transform(every, lambda k: F.struct(F.col("ball").alias("low"), at(own, k).alias("part")))).otherwise(
            F.array().cast("array<struct<low:bigint,part:int>>"))

    width = F.greatest(F.lit(1), "guest_chunks")
    grid = F.array_distinct(F.concat(along("home", "guest", lambda i, j: i * width + j), along("guest", "home", lambda j, i: i * width + j)))
    spread = placed.withColumn("place", F.explode(F.when(F.col("large").isNull(), one).otherwise(grid)))
    own = [F.pmod(F.xxhash64("n"), F.greatest(F.lit(1), f"{side}_chunks")).cast("int") for side in ("home", "guest")]
    part = F.col("place.part")
    here = {"home": F.col("home") & ((part < 0) | (F.floor(part / width) == own[0])), "guest": F.col("guest") & ((part < 0) | (part % width == own[1]))}
    return spread.withColumns({"low": F.col("place.low"), "part": part, **{f"{k}_": v for k, v in here.items()}}).drop(
        "place", "large", "home_chunks", "guest_chunks", "home", "guest").withColumnsRenamed({"home_": "home", "guest_": "guest"}).join(grams, "n")


def _shared(cell: pd.DataFrame, visit) -> None:
    """For every home of every ball of a cell: ``visit(home, guests, shared, sizes)`` with positions and numbers of shingles."""
    grams = cell["grams"].to_numpy()
    sizes = np.fromiter(map(len, grams), np.int64, len(grams))
    balls, homes, guests = cell["ball"].to_numpy(), cell["home"].to_numpy(bool), cell["guest"].to_numpy(bool)
    order = np.argsort(balls, kind="stable")
    for at in np.split(order, np.nonzero(np.diff(balls[order]))[0] + 1):
        own, other = at[homes[at]], at[guests[at]]
        if not len(own) or not len(other):
            continue
        both = np.concatenate((own, other))
        numbers = np.unique(np.concatenate(grams[both]), return_inverse=True)[1]
        ends = np.cumsum(sizes[both])
        split, marked = ends[len(own) - 1], np.zeros(numbers.max() + 1, np.int64)
        starts = ends[len(own):] - sizes[other] - split
        for home, end in zip(own, ends):
            mine = numbers[end - sizes[home]:end]
            marked[mine] = 1
            visit(home, other, np.add.reduceat(marked[numbers[split:]], starts), sizes)
            marked[mine] = 0


def _distances(similarity: tuple[int, int]):
    """Ring and link of each guest of a ball with the ball's vantage point."""
    up, down = similarity

    def run(cell: pd.DataFrame) -> pd.DataFrame:
        n, found = cell["n"].to_numpy(), []

        def visit(home, guests, shared, sizes):
            total = sizes[home] + sizes[guests] - shared
            # Distances up to the bound are ring 0 and 1 at its end, and so on.
            ring = (total - shared) * down // (total * (down - up))
            found.append(pd.DataFrame({"ball": n[home], "n": n[guests], "ring": ring, "linked": shared * down >= total * up}))

        _shared(cell, visit)
        return pd.concat(found) if found else pd.DataFrame({"ball": [], "n": [], "ring": [], "linked": []})

    return run


def _spanning(similarity: tuple[int, int]):
    """Edges that connect what links of the cell connect, beyond the known roots."""
    up, down = similarity

    def run(cell: pd.DataFrame) -> pd.DataFrame:
        n = cell["n"].to_numpy()
        names, root = np.unique(cell["root"].to_numpy(), return_inverse=True)
        forest, edges = Forest(len(names)), []

        def visit(home, guests, shared, sizes):
            near = shared * down >= (sizes[home] + sizes[guests] - shared) * up
            other = guests[near & (forest.parent[root[guests]] != forest.parent[root[home]])]
            if len(other):
                # One edge per set that joins.
                other = other[np.unique(forest.parent[root[other]], return_index=True)[1]]
                edges.append(np.stack((np.full(len(other), n[home]), n[other])))
                forest.join(np.full(len(other), root[home]), root[other])

        _shared(cell, visit)
        both = np.concatenate(edges, axis=1) if edges else np.empty((2, 0), np.int64)
        return pd.DataFrame({"big": both.max(axis=0), "small": both.min(axis=0)})

    return run


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                 similarity: tuple[int, int] = SIMILARITY, cell: int = CELL, distance: int = DISTANCE) -> DataFrame:
    """One document of each component stays, with all its columns: the one with the smallest id."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), row_key(text_col).alias("x"), text_or_empty(text_col).alias("text"))
    prints = _prints(source, words)
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "x")).alias("least")
    sets = staged(prints.groupBy("high", "low").agg(first, F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("keys").alias("keys")).select(
        F.monotonically_increasing_id().alias("n"), "least", "size", "fp", "keys"), "shingle-sets")
    entries = _near_fingerprints(sets, distance).unionAll(sets.select("n", "size", F.explode("keys").alias("key")))
    buckets = entries.groupBy("key").agg(F.min(F.struct("n", "size")).alias("head"), F.count(F.lit(1)).alias("members")).where("members > 1")
    # (ball, n): a vantage point is known by its number. A text meets it once, however many buckets they share.
    balls = staged(entries.join(staged(buckets.select(F.col("key").alias("bucket"), "head"), "buckets"), F.col("key") == F.col("bucket")).select(
        F.col("head.n").alias("ball"), F.col("head.size").alias("head_size"), "n", "size").where("n != ball").distinct(), "balls")
    grams = _all_grams(sets, balls.select("n").unionAll(balls.select(F.col("ball").alias("n"))).distinct(), source, words)
    point = balls.groupBy("ball").agg(F.first("head_size").alias("size")).select("ball", F.col("ball").alias("n"), "size", F.lit(True).alias("home"), F.lit(False).alias("guest"))
    members = balls.select("ball", "n", "size", F.lit(False).alias("home"), F.lit(True).alias("guest"))
    placed = staged(_dealt(point.unionAll(members), grams, cell).groupBy("low", "part").applyInPandas(
        _distances(similarity), "ball long, n long, ring int, linked boolean"), "rings")
    edges = placed.where("linked").select(F.col("n").alias("big"), F.col("ball").alias("small"))
    joined = stars(edges)
    # What is not connected with its vantage point looks for texts of its ring and of the next ones.
    root = joined.select(F.col("node").alias("n"), "root")
    of_ball = joined.select(F.col("node").alias("ball"), F.col("root").alias("ball_root"))
    rooted = staged(placed.select("ball", "n", "ring").join(root, "n", "left").join(of_ball, "ball", "left").select(
        "ball", "n", "ring", F.coalesce("root", "n").alias("root"), F.coalesce("ball_root", "ball").alias("ball_root")), "rooted-rings")
    apart = F.col("root") != F.col("ball_root")
    open_rings = staged(rooted.where(apart).select(F.col("ball").alias("open_ball"), F.explode(F.array(*[F.col("ring") + k for k in (-1, 0, 1)])).alias("reached"),
                                                   F.col("ring").alias("home_ring")).distinct(), "open-rings")
    met = rooted.join(open_rings, (F.col("ball") == F.col("open_ball")) & (F.col("ring") == F.col("reached"))).join(sets.select("n", "size"), "n")
    # Two homes meet in the ring of the first; texts that are connected with their vantage point are guests everywhere.
    homes = met.withColumns({"home": apart & (F.col("ring") == F.col("home_ring")), "guest": (F.col("ring") >= F.col("home_ring")) | ~apart})
    rings = staged(homes.where("home OR guest").select(F.xxhash64("ball", "home_ring").alias("ball"), "n", "root", "size", "home", "guest"), "ring-texts")
    edges = edges.unionAll(staged(_dealt(rings, grams, cell).groupBy("low", "part").applyInPandas(_spanning(similarity), "big long, small long"), "spanning"))
    joined = stars(edges)
    named = sets.select("n", "least").join(joined, F.col("n") == F.col("node"), "left").groupBy(F.coalesce("root", "n").alias("root")).agg(F.min("least").alias("least"))
    kept = staged(named.select("least.id", "least.x"), "kept")
    repeated = not prints.groupBy("id", "x").count().where("count > 1").isEmpty()
    return keep_rows(docs, kept, repeated, id_col, text_col)

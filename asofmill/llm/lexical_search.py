"""Ranked lexical search by dense blocked multiplication: item vocabulary tiles times document impact tiles, tie-safe top k.

A term is a run of ASCII letters and digits and of anything beyond ASCII, with only A-Z in lower case. What a document gains by
holding a term (its impact) is an integer; an item's score of a document sums the impacts of the item's terms, repeats included.
The query items are a stated set: they come in blocks of at most ``ITEMS`` items and ``PAIRS`` (item, term) pairs, and each
block meets all documents. In a task a tile of ``TILE`` documents becomes a dense matrix of impacts, an item tile one of term
counts, and BLAS multiplies them in float64. Columns are cut where a partial sum could reach 2^53, so every product is an exact
integer; sums over column tiles are 64-bit integers.

Defined results: null and empty texts have no terms, are no documents of the statistics and are never found; items without terms
give no rows; every row of ``items`` is an item of its own, also where ids repeat or are null; repeated documents are ranked
separately; equal scores go by ascending id, rows without id last; extra columns are ignored; an empty table on either side gives
an empty result. A count of a term that could reach 2^53 alone is cut into layers.

Plan: per block one pass over documents for the document frequencies and one for the scores; nothing is shuffled but one row per
term and task, and ``k`` rows per item and task, which are cut to ``k`` per group of tasks before they meet per item. The
vocabulary that is broadcast is bounded by ``PAIRS``. Texts are tokenised whole, in slices of bounded size.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged

TOP = 20
ITEMS = 1024
PAIRS = 1 << 20
#: Documents, items and columns of one dense multiplication.
TILE = 512
ITEM_TILE = 256
COLUMNS = 1024
EXACT = 1 << 53
#: The largest quotient of an impact, before its weight.
GAIN = 1_000_000
SLICE = 1 << 22
#: Longer terms are known by their digest, which bounds the bytes of a vocabulary.
LONG_TERM = 64
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_slices(text: bytes | None) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text in order, in lists of bounded size."""
    clean, start = (text or b"").translate(_BYTES), 0
    while start < len(clean):
        end = len(clean) if len(clean) - start <= SLICE else clean.rfind(b" ", start, start + SLICE)
        if end <= start:  # one term longer than a slice
            end = clean.find(b" ", start + SLICE)
            end = len(clean) if end < 0 else end
        yield clean[start:end].split()
        start = end + 1


def _name(term: bytes) -> bytes:
    return term if len(term) <= LONG_TERM else b" " + hashlib.sha256(term).digest()


def _item_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        terms, counts = [], []
        for text in batch.pop("text"):
            found = Counter()
            for part in term_slices(text):
                found.update(map(_name, part))
            terms.append(list(found))
            counts.append(list(found.values()))
        yield batch.assign(terms=terms, counts=counts)


class _Vocabulary(dict):
    """Numbers of terms; a term of another length than the vocabulary's is not hashed anew where it is short."""

    def number(self, term: bytes) -> int:
        return self.get(term if len(term) <= LONG_TERM else _name(term), -1)


def _counted(texts, vocabulary: _Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms per text, and (text, term, occurrences) of the terms that the vocabulary holds."""
    sizes, found, get = np.zeros(len(texts), np.int64), [np.empty(0, np.int64)], vocabulary.get
    for n, text in enumerate(texts):
        for words in term_slices(text):
            sizes[n] += len(words)
            if words and len(max(words, key=len)) > LONG_TERM:
                at = np.fromiter(map(vocabulary.number, words), np.int64, len(words))
            else:
                at = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
            found.append(at[at >= 0] + (n << 32))
    codes, times = np.unique(np.concatenate(found), return_counts=True)
    return sizes, codes >> 32, codes & 0xFFFFFFFF, times


def _statistics(docs: DataFrame, vocabulary) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms of all of them, and document frequencies of the vocabulary."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = vocabulary.value
        total, df = np.zeros(2, np.int64), np.zeros(len(known), np.int64)
        for batch in batches:
            for low in range(0, len(batch), TILE):
                sizes, _, term, _ = _counted(batch["text"].to_numpy()[low:low + TILE], known)
                total += ((sizes > 0).sum(), sizes.sum())
                df += np.bincount(term, minlength=len(df))
        held = np.nonzero(df)[0]
        yield pd.DataFrame({"term": np.concatenate((held, [-1, -2])), "n": np.concatenate((df[held], total))})

    # One row per term of the block.
    rows = docs.select("text").mapInPandas(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    by_term = dict(zip(rows["term"].tolist(), rows["n"].tolist()))
    df = np.array([by_term.get(t, 0) for t in range(len(vocabulary.value))], dtype=np.int64)
    return by_term.get(-1, 0), by_term.get(-2, 0), df


@dataclass
class _Columns:
    """Part of an item tile: term numbers of its columns and the counts, one row per column."""

    terms: np.ndarray
    counts: np.ndarray


def item_columns(item: np.ndarray, term: np.ndarray, count: np.ndarray, weight: np.ndarray, items: int, columns: int = COLUMNS,
                 exact: int = EXACT) -> list[_Columns]:
    """Column tiles of the items whose partial sums stay below ``exact``."""
    tiles = []
    most = np.maximum(1, weight[term]) * GAIN
    while len(term):
        now = np.minimum(count, np.maximum(1, (exact - 1) // most))  # what is left makes another layer
        order = np.argsort(term, kind="stable")
        i, t, c = item[order], term[order], now[order]
        names, first = np.unique(t, return_index=True)
        bound = np.maximum.reduceat(c * most[order], first).tolist()
        start, total = 0, 0
        for end in range(len(names) + 1):
            if end == len(names) or total + bound[end] >= exact or end - start == columns:
                if end > start:
                    inside = slice(first[start], first[end] if end < len(names) else len(t))
                    dense = np.zeros((end - start, items))
                    dense[np.searchsorted(names, t[inside]) - start, i[inside]] = c[inside]
                    tiles.append(_Columns(names[start:end], dense))
                start, total = end, 0
            if end < len(names):
                total += bound[end]
        rest = count > now
        item, term, count, most = item[rest], term[rest], (count - now)[rest], most[rest]
    return tiles


def tile_scores(tiles: list[_Columns], doc: np.ndarray, term: np.ndarray, impact: np.ndarray, docs: int, items: int) -> np.ndarray:
    """Scores (documents, items) as 64-bit integers; ``doc``, ``term``, ``impact`` are ordered by document and term."""
    scores = np.zeros((docs, items), np.int64)
    place = np.full(int(max([-1, *(t.terms.max() for t in tiles)])) + 1, -1, np.int64)
    for tile in tiles:
        place[:] = -1
        place[tile.terms] = np.arange(len(tile.terms))
        known = term < len(place)
        column = np.where(known, place[np.where(known, term, 0)], -1)
        held = column >= 0
        present, column = np.unique(column[held], return_inverse=True)  # only columns that a document of the tile holds
        if len(present):
            dense = np.zeros((docs, len(present)))
            dense[doc[held], column] = impact[held]
            scores += np.rint(dense @ tile.counts[present]).astype(np.int64)
    return scores


class _Best:
    """The k best rows of each item so far: highest score, then smallest id, rows without id last."""

    def __init__(self, k: int, items: int):
        self.k, self.floor = k, np.ones(items, np.int64)
        self.item, self.score, self.id, self.none = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def add(self, scores: np.ndarray, ids: np.ndarray, none: np.ndarray, first_item: int) -> None:
        at, item = np.nonzero(scores >= self.floor[first_item:first_item + scores.shape[1]])
        if not len(at):
            return
        merged = [np.concatenate(x) for x in ((self.item, item + first_item), (self.score, scores[at, item]), (self.id, ids[at]), (self.none, none[at]))]
        order = np.lexsort((merged[2], merged[3], -merged[1], merged[0]))
        merged = [x[order] for x in merged]
        starts = np.searchsorted(merged[0], merged[0])
        kept = np.arange(len(order)) - starts < self.k
        self.item, self.score, self.id, self.none = (x[kept] for x in merged)
        # A later row of an equal score may have a smaller id, so the floor itself stays eligible.
        full = np.nonzero(np.bincount(self.item, minlength=len(self.floor)) == self.k)[0]
        self.floor[full] = self.score[np.searchsorted(self.item, full, side="right") - 1]


def _block_top(docs: DataFrame, block: pd.DataFrame, k: int, group: int) -> DataFrame:
    """item_id, rank, doc_id, score of the items of one block."""
    spark = docs.sparkSession
    numbers = _Vocabulary()
    term = np.array([numbers.setdefault(t, len(numbers)) for found in block["terms"] for t in found], dtype=np.int64)
    count = np.array([c for found in block["counts"] for c in found], dtype=np.int64)
    item = np.repeat(np.arange(len(block)), [len(found) for found in block["terms"]])
    shared = spark.sparkContext.broadcast(numbers)
    documents, terms, df = _statistics(docs, shared)
    weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(d) + 1))) for d in df], dtype=np.int64)
    asked = spark.sparkContext.broadcast((item, term, count, weight))
    items = len(block)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (item, term, count, weight), known, best = asked.value, shared.value, _Best(k, items)
        tiles = []
        for low in range(0, items, ITEM_TILE):
            here = (item >= low) & (item < low + ITEM_TILE) & (weight[term] > 0)
            width = min(ITEM_TILE, items - low)
            tiles.append((low, width, item_columns(item[here] - low, term[here], count[here], weight, width)))
        for batch in batches:
            for low in range(0, len(batch), TILE):
                part = batch.iloc[low:low + TILE]
                sizes, doc, at, times = _counted(part["text"].to_numpy(), known)
                share = np.array([75 + 25 * int(n) * documents // max(1, terms) for n in sizes], dtype=np.int64)
                impact = weight[at] * (1_000_000_000 * times // (1000 * times + 12 * share[doc]))
                ids, none = part["id"].fillna(0).to_numpy(np.int64), part["none"].to_numpy(bool)
                for first, width, columns in tiles:
                    best.add(tile_scores(columns, doc, at, impact, len(part), width), ids, none, first)
        yield pd.DataFrame({"item": best.item, "id": best.id, "none": best.none, "score": best.score})

    named = F.broadcast(spark.createDataFrame(
        [(n, None if pd.isna(i) else int(i)) for n, i in enumerate(block["item_id"])], "named long, item_id long"))  # at most ITEMS rows
    order = [F.desc("score"), F.asc("none"), F.asc("id")]
    found = docs.mapInPandas(run, "item long, id long, none boolean, score long").withColumn(
        "group", F.floor(F.spark_partition_id() / group))
    for keys in (["item", "group"], ["item"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
    return found.join(named, F.col("item") == F.col("named")).select(
        "item_id", F.col("rank").cast("int"), F.when(~F.col("none"), F.col("id")).alias("doc_id"), "score")


def lexical_top(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                item_text: str = "text", most_items: int = ITEMS, most_pairs: int = PAIRS, group: int = 64) -> DataFrame:
    """The ``k`` highest-scoring documents of each item: item_id, rank, doc_id, score."""
    documents = docs.select(F.col(id_col).cast("long").alias("id"), F.col(id_col).isNull().alias("none"), F.col(text_col).cast("binary").alias("text"))
    asked = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).cast("binary").alias("text"))
    known = staged(asked.mapInPandas(_item_terms, "item_id long, terms array<binary>, counts array<long>").withColumn(
        "row", F.monotonically_increasing_id()).where(F.size("terms") > 0), "search-items")
    size = known.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("pairs")).first()
    blocks = max(1, -(-size.n // most_items), -(-size.pairs // most_pairs)) if size.n else 0
    while blocks:  # dealt by hash: more blocks until each is within its bounds or a single item
        dealt = known.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
        over = dealt.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("terms")).alias("pairs")).where(
            (F.col("n") > 1) & ((F.col("n") > most_items) | (F.col("pairs") > most_pairs)))
        if blocks == 1 or over.isEmpty():
            break
        blocks *= 2
    found = None
    for n in range(blocks):
        # At most most_items items and most_pairs pairs, or one item.
        block = dealt.where(F.col("block") == n).drop("block").toPandas().sort_values("row")
        if len(block):
            part = staged(_block_top(documents, block, k, group), "search-top")
            found = part if found is None else found.unionAll(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return found

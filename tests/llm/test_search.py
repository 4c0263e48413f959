"""Lexical and vector search against plain versions."""

import math
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from asofmill.llm import lexical_search, queries, vector_search

from ..compare import compare

TERM = re.compile("[^\\x00-\\x2f\\x3a-\\x40\\x5b-\\x60\\x7b-\\x7f]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(FOLD))


def plain_top(docs, items, k=20):
    """(item position, rank, doc_id, score) by plain loops."""
    held = [(i, terms(t)) for i, t in docs]
    held = [(i, t) for i, t in held if t]
    n_docs, size = len(held), sum(len(t) for _, t in held)
    out = []
    for at, (_, text) in enumerate(items):
        scored = []
        for i, found in held:
            m, score = 75 + 25 * len(found) * n_docs // size, 0
            for term in terms(text):
                tf, df = found.count(term), sum(term in t for _, t in held)
                if tf:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * (10**9 * tf // (1000 * tf + 12 * m))
            if score:
                scored.append((-score, i is None, i or 0))
        out += [(at, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k])]
    return out


@pytest.mark.parametrize("settings", [{}, {"most_items": 2, "group": 1}, {"k": 3, "most_pairs": 5}])
def test_lexical_top(spark, monkeypatch, settings):
    rng = np.random.default_rng(4)
    pool = ["A", "b", "C3", "d4", "é", "Ünder", "漢", "x" * 70, "Y" * 70]
    docs = [(int(i), " ".join(rng.choice(pool, rng.integers(0, 12)))) for i in rng.integers(0, 60, 90)] + [(7, None), (None, "a b é"), (8, "-_- !"), (9, "A,b;C3\x00d4\x7fé")]
    items = [(i, " ".join(rng.choice(pool, 4))) for i in range(5)] + [(1, "b b b"), (None, "ünder Ünder"), (6, None), (7, "unknown")]
    if settings:
        for name, value in (("TILE", 7), ("ITEM_TILE", 2), ("SLICE", 16)):
            monkeypatch.setattr(lexical_search, name, value)
    given = spark.createDataFrame(docs, "doc_id long, text string").repartition(5).withColumn("score", F.lit(1))
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit(1))
    found = [tuple(r) for r in lexical_search.lexical_top(given, asked, **settings).collect()]
    expected = [(items[at][0], rank, i, s) for at, rank, i, s in plain_top(docs, items, settings.get("k", 20))]
    assert sorted(found, key=repr) == sorted(expected, key=repr)


@pytest.mark.parametrize("exact", [1 << 53, 1 << 38, 1 << 31])
def test_partial_sums_stay_exact(exact):
    """Cut columns and layered counts give the same integers as plain sums."""
    rng = np.random.default_rng(1)
    pairs = {(int(i), int(t)): int(rng.integers(1, 2000)) for i, t in zip(rng.integers(0, 5, 60), rng.integers(0, 30, 60))}
    item, term = (np.array(x) for x in zip(*pairs))
    count, weight = np.array(list(pairs.values())), rng.integers(1, 900, 30)
    tiles = lexical_search.item_columns(item, term, count, weight, 5, columns=8, exact=exact)
    for tile in tiles:
        assert (tile.counts * (weight[tile.terms] * lexical_search.GAIN)[:, None]).sum(axis=0).max() < exact and len(tile.terms) <= 8
    doc, at = np.divmod(np.sort(rng.choice(4 * 30, 50, replace=False)), 30)
    impact = weight[at] * rng.integers(1, lexical_search.GAIN, 50)
    expected = [[sum(int(c) * int(v) for (i, t), c in pairs.items() for d, a, v in zip(doc, at, impact) if i == row and t == a and d == col) for row in range(5)] for col in range(4)]
    assert lexical_search.tile_scores(tiles, doc, at, impact, 4, 5).tolist() == expected


def added(values):
    total = 0.0
    for value in values.tolist():  # sum() would compensate for rounding
        total += value
    return total


def plain_nearest(vectors, every, k):
    out = []
    good = [(n, i, np.array(v)) for n, (i, v) in enumerate(vectors)
            if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    for n, i, v in good:
        if i is None or i % every:
            continue
        scored = []
        for m, j, w in good:
            if m != n and len(v) == len(w):
                dot, a, b = added(v * w), added(v * v), added(w * w)
                scored.append((-(dot / (math.sqrt(a) * math.sqrt(b))), j is None, j or 0))
        out += [(i, r + 1, None if none else j, -s) for r, (s, none, j) in enumerate(sorted(scored)[:k])]
    return out


@pytest.mark.parametrize("settings", [{}, {"query_values": 40, "candidate_values": 100, "group": 1}])
def test_nearest_neighbours(spark, settings):
    rng = np.random.default_rng(8)
    vectors = [(i, rng.normal(size=8).tolist()) for i in range(120)]
    vectors += [(i, [1.0, 2.0] + [0.0] * 6) for i in range(200, 230)] + [(i, [2.0, 4.0] + [0.0] * 6) for i in (31, 35)]  # many copies and multiples
    vectors += [(i, (np.array(vectors[i][1]) + rng.normal(size=8) * 1e-6).tolist()) for i in range(0, 60, 5)]  # ids that repeat
    vectors += [(205, [1.0, 2.0] + [0.0] * 6), (None, [1.0, 2.0] + [0.0] * 6), (None, None), (50, None), (55, []), (60, [0.0] * 8), (65, [float("nan")] + [1.0] * 7),
                (70, [float("inf")] + [1.0] * 7), (75, [None] + [1.0] * 7), (80, [1.0, 1.0]), (85, [1.0, -1.0]), (390, [1e300] * 8), (395, [1e-300] * 7 + [-1e-300]), (100, [3.0])]
    given = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(4).withColumn("q", F.lit("clash"))
    found = [tuple(r) for r in vector_search.nearest_neighbours(given, every=5, **settings).collect()]
    expected = plain_nearest([(i, v) for i, v in vectors if v is None or 1e300 not in v and 1e-300 not in v], 5, 5)
    scaled = plain_nearest([(i, None if v is None else [x and x / 1e300 if x == 1e300 else x and x * 1e300 if x and abs(x) == 1e-300 else x for x in v]) for i, v in vectors], 5, 5)
    # Components beyond the squares of doubles are scaled here by another factor than there: equal but for the last digits.
    rounded = [sorted([(*r[:3], round(r[3], 12)) for r in rows], key=repr) for rows in (found, scaled)]
    assert rounded[0] == rounded[1] and len(expected) < len(scaled)
    assert {r for r in found if not {390, 395} & {r[0], r[2]}} == {r for r in scaled if not {390, 395} & {r[0], r[2]}}


def test_codes_bound_the_cosine():
    rng = np.random.default_rng(3)
    for width in (1, 64, 2500):  # beyond 1,024 dimensions products are added in slices
        a, b = (rng.normal(size=(50, width)) * rng.choice([1e-3, 1, 1e5], (50, 1)) for _ in range(2))
        near, off = vector_search.Codes(a).products(vector_search.Codes(b), slice(None))
        truth = (a @ b.T) / np.linalg.norm(a, axis=1)[:, None] / np.linalg.norm(b, axis=1)
        assert (np.abs(near - truth) <= off).all() and off.max() < 0.05


def test_driver_vectors_and_documents(spark):
    con = duckdb.connect()
    folder = "/root/testdata/sf0.1"
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{folder}/embeddings.parquet')")
    name = "op12_nearest_neighbours"
    assert compare(spark, con, queries.queries()[name], queries.oracle_sql()[name], folder) == ""

"""The conversation trie and its subtree sums against plain versions."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from asofmill.llm import queries
from asofmill.llm.centroids import subtree_sums
from asofmill.llm.prefix_trie import conversation_trie

from ..compare import compare


def plain_sums(parent, values):
    total = values.copy()
    for n in range(len(parent)):
        above = parent[n]
        while above >= 0:
            total[above] += values[n]
            above = parent[above]
    return total


@pytest.mark.parametrize("shape", ["random", "chain", "star", "comb", "forest"])
def test_subtree_sums(shape):
    rng = np.random.default_rng(2)
    for size in (1, 2, 3, 7, 64, 501):
        at = np.arange(size)
        parent = {"random": np.array([rng.integers(-1, n) if n else -1 for n in at]), "chain": at - 1, "star": np.where(at, 0, -1),
                  "comb": np.where(at % 2, at - 1, at - 2).clip(-1), "forest": np.where(at % 7, at - 1, -1)}[shape]
        names = rng.permutation(size)  # parents need not come first
        mixed = np.empty(size, np.int64)
        mixed[names] = np.where(parent < 0, -1, names[parent])
        values = rng.integers(-5, 9, (size, 2))
        assert np.array_equal(subtree_sums(mixed, values), plain_sums(mixed, values))


def test_a_long_chain_takes_few_rounds():
    size = 100_000
    assert subtree_sums(np.arange(size) - 1, np.ones((size, 1), np.int64))[0, 0] == size


def conversations(seed):
    rng = random.Random(seed)
    rows = []
    for c in range(90):
        if rng.random() < 0.1:
            continue  # a base may be missing
        start = rng.choice([[], ["hot"], ["hot", "second"], ["a"]])
        for t, text in enumerate(start + [rng.choice("xyz") for _ in range(rng.randrange(0 if start else 1, 9))]):
            rows.append((c, t, rng.choice(["user", None]) if rng.random() < 0.1 else "user", text))
    rows += [(c, t, "user", f"step {t}") for c in (100, 105, 106, 110) for t in range(40)]
    return rows


@pytest.mark.parametrize("settings", [{}, {"part": 2, "factor": 2, "band": 3, "cell": 4}, {"part": 4, "factor": 8, "band": 7, "cell": 1}])
def test_trie_against_sql(spark, tmp_path, settings):
    df = spark.createDataFrame(conversations(5), "conv_id long, turn long, role string, text string").withColumn("leaves", F.lit("clash"))
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    query = lambda s, f: conversation_trie(s.read.parquet(f"{f}/conversations.parquet"), **settings)
    assert compare(spark, con, query, queries.oracle_sql()["op13_conversation_trie"], str(tmp_path)) == ""


def test_driver_conversations(spark):
    folder, name = "/root/testdata/sf0.01", "op13_conversation_trie"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{folder}/conversations.parquet')")
    assert compare(spark, con, queries.queries()[name], queries.oracle_sql()[name], folder) == ""


def test_conversations_without_turns(spark):
    """All turns of conversation 3 are to come from conversation 0, which does not exist: it is a member of the root only."""
    assert zlib.crc32(b"3") % 9 >= 2
    alone = spark.createDataFrame([(3, 0, "u", "x"), (3, 1, "u", "y")], "conv_id long, turn long, role string, text string")
    assert [tuple(r) for r in conversation_trie(alone).collect()] == [(3, 0, None, 1, 0, 1, 0, hashlib.sha256(b"3").hexdigest())]

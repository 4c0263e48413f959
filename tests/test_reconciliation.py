"""Pairs of two books against the rule in plain loops."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from asofmill.operators import reconciliation as R

BOOK = "record_id bigint, native_id string, symbol string, side string, quantity bigint, at timestamp, price double"
START = datetime(2024, 1, 1)


def plain(local, broker, seconds):
    """The rule: equal native ids by rank, then always the closest two records that are left."""
    pairs = {}
    for native in sorted({r[1] for r in local if r[1] is not None}):
        sides = [sorted(r[0] for r in book if r[1] == native) for book in (local, broker)]
        pairs.update({pair: "native_id" for pair in zip(*sides)})
    used = [{p[n] for p in pairs} for n in (0, 1)]
    options = sorted(
        (abs((a[5] - b[5]).total_seconds()), a[5], b[5], a[0], b[0])
        for a in local for b in broker
        if None not in (*a[2:6], b[5]) and a[2:5] == b[2:5] and a[0] not in used[0] and b[0] not in used[1]
        and abs((a[5] - b[5]).total_seconds()) <= seconds)
    for *_, a, b in options:
        if a not in used[0] and b not in used[1]:
            pairs[a, b] = "nearest"
            used[0].add(a)
            used[1].add(b)
    return pairs


def book(rng, size, instants):
    return [(n, rng.choice([None, None, None, "x", "y", str(rng.randrange(size))]), rng.choice(["A", "A", "A", "B", None]), rng.choice(["buy", "buy", "sell"]),
             rng.choice([1, 1, 2]), rng.choice([None] + [START + timedelta(seconds=rng.randrange(instants))] * 12), float(rng.randrange(3))) for n in range(size)]


@pytest.mark.parametrize("seed,instants", [(0, 400), (1, 12), (2, 200_000)])
def test_pairs_are_those_of_the_rule(spark, seed, instants):
    rng = random.Random(seed)
    local, broker = book(rng, 150, instants), book(rng, 120, instants)
    seconds = 10 if instants < 1000 else 20_000
    rows = R.reconcile(spark.createDataFrame(local, BOOK), spark.createDataFrame(broker, BOOK), seconds, F.lit(0.5)).collect()
    assert {(r.local_id, r.broker_id): r.matched_by for r in rows if r.matched_by} == plain(local, broker, seconds)
    for name, records in (("local_id", local), ("broker_id", broker)):
        assert sorted(r[name] for r in rows if r[name] is not None) == list(range(len(records)))
    assert {r.status for r in rows if r.matched_by is None} == {"only_local", "only_broker"}


def test_many_records_of_one_instant_pair_by_rank(spark):
    """More copies than a chunk holds, in two rounds: what the same instant leaves over goes to the next one."""
    left = spark.range(10_000).selectExpr("id AS record_id", "CAST(NULL AS string) AS native_id", "'A' AS symbol", "'buy' AS side", "1L AS quantity",
                                          "TIMESTAMP '2024-01-01 00:00:00' AS at", "1D AS price")
    right = left.withColumn("at", F.when(F.col("record_id") >= 6000, F.col("at") + F.expr("INTERVAL 2 SECONDS")).otherwise(F.col("at")))
    got = R.reconcile(left, right, 5, F.lit(0.0))
    assert got.count() == 10_000 and got.where("local_id = broker_id AND status = 'matched'").count() == 10_000


def test_differences_are_named(spark):
    local = [(1, "x", "A", "buy", 1, START, 1.0), (2, "y", "A", "buy", 1, START, None), (3, "z", None, "buy", 1, START, 2.0), (4, None, "A", "buy", 1, START, 2.0)]
    broker = [(7, "x", "A", "sell", 2, START + timedelta(minutes=1), 1.2), (8, "y", "A", "buy", 1, START, 1.0), (9, "z", None, "buy", 1, START, 2.1)]
    got = R.reconcile(spark.createDataFrame(local, BOOK), spark.createDataFrame(broker, BOOK), 30, F.lit(0.15))
    assert {r.local_id: (r.broker_id, r.status, r.differences) for r in got.collect()} == {
        1: (7, "differing", ["side", "quantity", "price", "at"]), 2: (8, "differing", ["price"]), 3: (9, "matched", []), 4: (None, "only_local", None)}


def test_empty_books(spark):
    none, one = spark.createDataFrame([], BOOK), spark.createDataFrame([(1, None, "A", "buy", 1, START, 1.0)], BOOK)
    assert R.reconcile(none, none, 1, F.lit(0)).count() == 0
    assert [tuple(r)[:3] for r in R.reconcile(none, one.withColumn("extra", F.lit(1)), 1, F.lit(0)).collect()] == [(None, 1, "only_broker")]


def test_result_takes_two_joins(spark):
    """A record without a partner has no other key; it must not cost a pass over the pairs, nor meet all others like it."""
    local, broker = (spark.createDataFrame([(n, native, "A", "buy", 1, START, 1.0) for n, native in enumerate(ids)], BOOK) for ids in (["x", "y", None], ["x", "z"]))
    got = R.reconcile(local, broker, 0, F.lit(0))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2
    assert sorted(map(str, (tuple(r)[:4] for r in got.collect()))) == sorted(map(str, [
        (0, 0, "matched", "native_id"), (1, 1, "matched", "nearest"), (2, None, "only_local", None)]))

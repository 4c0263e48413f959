"""Operators over a hot key give the same result sliced and unsliced."""

import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from asofmill.functions import ordered as O
from asofmill.operators import ledger as L
from asofmill.operators.versions import rows_differ

from . import fixtures as T

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(7)
    rows = []
    for i in range(600):
        key = "hot" if rng.random() < 0.4 else rng.choice(["a", "b", None])
        rows.append((i, key, START + timedelta(minutes=rng.randrange(0, 20 * 1440)), rng.choice("lr"), rng.randrange(-5, 9)))
    return spark.createDataFrame(rows, "id bigint, key string, at timestamp, side string, v bigint").persist()


@pytest.mark.parametrize("hot_rows", [None, 1, 100, 1_000_000])
def test_running_sums(events, hot_rows):
    got = O.running_sums(events, ["key"], [F.col("at"), F.col("id")], {"total": F.col("v")}, F.to_date("at"), hot_rows)
    window = Window.partitionBy("key").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0)
    assert rows_differ(got, events.withColumn("total", F.sum("v").over(window))).count() == 0


@pytest.mark.parametrize("hot_rows", [None, 1, 100, 1_000_000])
def test_previous_values(events, hot_rows):
    got = O.previous_values(events, ["key"], ["at", "id"], {"was": F.col("v"), "when": F.col("at")}, F.to_date("at"), hot_rows)
    window = Window.partitionBy("key").orderBy("at", "id")
    want = events.withColumn("was", F.lag("v").over(window)).withColumn("when", F.lag("at").over(window))
    assert rows_differ(got, want).count() == 0


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("hot_rows", [None, 1, 1_000_000])
def test_latest_as_of(events, hot_rows, strict):
    left = events.where("side = 'l'").select("id", "key", "at")
    # Copies at the very time of left rows separate the inclusive from the strict rule.
    right = events.where("side = 'r'").unionByName(events.where("side = 'l' and id % 5 = 0")).select("id", "key", "at", "v")
    got = O.latest_as_of(left, right, ["key"], "at", "at", ["id", "v"], strict=strict, tie_break=["id"], hot_rows=hot_rows)
    rights = right.collect()
    found = {r["id"]: (r["asof_id"], r["asof_v"]) for r in got.collect()}
    lefts = left.collect()
    assert len(found) == len(lefts)
    for row in lefts:
        seen = [r for r in rights if r["key"] == row["key"] and (r["at"] < row["at"] or (not strict and r["at"] == row["at"]))]
        best = max(seen, key=lambda r: (r["at"], r["id"]), default=None)
        assert found[row["id"]] == ((best["id"], best["v"]) if best else (None, None))


def test_ledger_of_a_hot_sleeve(spark):
    rng = random.Random(3)
    fills = spark.createDataFrame(
        [("a" if rng.random() < 0.7 else "b", "BBTEST", rng.choice(T.DAYS), i, rng.randrange(1, 9), Decimal("10.5"), Decimal(1))
         for i in range(120)],
        "account string, symbol string, session date, seq bigint, quantity bigint, price decimal(18,8), commission decimal(18,8)",
    )
    splits = T.actions(spark).where("kind = 'split'").select("symbol", "effective_session", "split_ratio")
    raw = spark.createDataFrame([("BBTEST", "d1", T.DAYS[3], Decimal(1), T.DAYS[5])],
                                "symbol string, action_id string, ex_session date, amount decimal(18,8), pay_date date")
    paid = L.payment_sessions(raw, T.sessions(spark))
    marks = T.bars(spark).select("symbol", "session", F.col("open").alias("mark"))
    whole = L.ledger_replay(fills, splits, paid, marks, F.lit(1000))
    sliced = L.ledger_replay(fills, splits, paid, marks, F.lit(1000), slice_by=F.col("session"), hot_rows=50)
    assert whole.count() > 120
    assert rows_differ(whole, sliced).count() == 0

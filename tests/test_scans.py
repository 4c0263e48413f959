"""Running values over sliced keys against plain loops, whatever the slices."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from asofmill.functions import scans as S

START = date(2024, 1, 1)
SLICES = {"one": lambda: F.lit(0), "day": lambda: F.col("day"), "month": lambda: F.date_trunc("MONTH", "day")}


@pytest.fixture(scope="module")
def rows(spark):
    """A hot key, small ones and a null one; several rows a day, values that are null."""
    rng = random.Random(3)
    made = [("hot" if rng.random() < 0.6 else rng.choice(["a", None]), START + timedelta(days=rng.randrange(70)), n, rng.choice([None, *range(-5, 9)])) for n in range(500)]
    return spark.createDataFrame(made, "key string, day date, n long, v long").persist()


def in_order(rows, keyed=True):
    found = {}
    for r in sorted(rows, key=lambda r: (r["day"], r["n"])):
        found.setdefault(r["key"] if keyed else None, []).append(r)
    return found


PLAIN = {
    "sum": lambda vs: sum(vs) if vs else None, "max": lambda vs: max(vs, default=None), "min": lambda vs: min(vs, default=None), "last": lambda vs: vs[-1] if vs else None,
}


@pytest.mark.parametrize("slices", SLICES)
@pytest.mark.parametrize("keys", [["key"], []])
def test_running(rows, keys, slices):
    scans = {f"{kind}_{before}": S.Scan(kind, F.col("v"), before) for kind in PLAIN for before in (False, True)}
    got = {r["n"]: r for r in S.running(rows, keys, ["day", "n"], scans, SLICES[slices]()).collect()}
    assert len(got) == 500
    for members in in_order(rows.collect(), bool(keys)).values():
        for at, r in enumerate(members):
            for kind, plain in PLAIN.items():
                for before in (False, True):
                    seen = [m["v"] for m in members[:at + (not before)] if m["v"] is not None]
                    assert got[r["n"]][f"{kind}_{before}"] == plain(seen), (kind, before)


@pytest.mark.parametrize("block", [1, 7, 65_536])
@pytest.mark.parametrize("slices", SLICES)
def test_moving(rows, block, slices):
    values = {"three": (3, F.sum("v")), "seven": (7, F.count("v")), "one": (1, F.max("v"))}
    got = {r["n"]: r for r in S.moving(rows, ["key"], ["day", "n"], values, SLICES[slices](), block).collect()}
    assert len(got) == 500 and "__row_no" not in got[0].asDict()
    for members in in_order(rows.collect()).values():
        for at, r in enumerate(members):
            tail = lambda w: [m["v"] for m in members[max(0, at + 1 - w):at + 1] if m["v"] is not None]  # noqa: B023, E731
            assert (got[r["n"]]["three"], got[r["n"]]["seven"], got[r["n"]]["one"]) == (PLAIN["sum"](tail(3)), len(tail(7)), PLAIN["max"](tail(1)))


@pytest.mark.parametrize("keys", [["key"], []])
def test_overlaps_and_islands(spark, keys):
    rng = random.Random(9)
    make = lambda n: [(i, rng.choice(["a", "b", None]), START + timedelta(days=(d := rng.randrange(200))), START + timedelta(days=d + rng.randrange(6))) for i in range(n)]
    left, right = make(300), make(25)
    shape = "i long, key string, start date, end date"
    got = S.overlaps(spark.createDataFrame(left, shape), spark.createDataFrame(right, shape), keys, "start", "end").collect()
    want = {i: any((not keys or k == o) and s <= t and e >= b for _, o, b, t in right) for i, k, s, e in left}
    assert {r["i"]: r["overlaps"] for r in got} == want and 0 < sum(want.values()) < 300
    merged = S.islands(spark.createDataFrame(right, shape), keys, "start", "end", F.date_trunc("MONTH", "start")).collect()
    assert sum(r["intervals"] for r in merged) == 25
    days = {(r["key"] if keys else None, r["start"] + timedelta(days=d)) for r in merged for d in range((r["end"] - r["start"]).days + 1)}
    assert days == {(k if keys else None, s + timedelta(days=d)) for _, k, s, e in right for d in range((e - s).days + 1)}


def test_one_shuffle_of_the_rows(rows, capsys):
    """Rows are shuffled once and joined with nothing; the other exchanges hold one row per slice."""
    S.running(rows, ["key"], ["day", "n"], {"total": S.Scan("sum", F.col("v"))}, F.col("day")).explain()
    plan = capsys.readouterr().out
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 3

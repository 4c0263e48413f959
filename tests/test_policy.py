"""Rules over time against plain loops and hand-made cases."""

import hashlib
import math
import random
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from asofmill.operators import allocation as N
from asofmill.operators import categories as K
from asofmill.operators import controls as H
from asofmill.operators import labels as Y
from asofmill.operators import performance as P
from asofmill.operators import signals as G

START = date(2024, 1, 1)
D = Decimal


def days(n):
    return START + timedelta(days=n)


def month():
    return F.date_trunc("MONTH", "session")


def test_drawdowns_by_hand(spark):
    """Flat, one that recovers exactly, one that never does, a new account, and equal lowest values."""
    rows = [("a", days(n), D(v)) for n, v in enumerate([100, 100, 90, 80, 80, 100, 120, 60, 119])] + [("flat", days(n), D(5)) for n in range(4)] + [("one", days(0), D(1))]
    got = P.drawdowns(spark.createDataFrame(rows, "account string, session date, equity decimal(20,2)"), ["account"], F.col("session"))
    assert sorted(tuple(r) for r in got.collect()) == [
        ("a", days(1), D(100), days(3), D(80), days(5), 3, 0.2), ("a", days(6), D(120), days(7), D(60), None, 2, 0.5)]


def equity_rows(rng):
    rows, value = [], {}
    for n in range(400):
        account = "hot" if rng.random() < 0.7 else rng.choice("ab")
        value[account] = max(1, value.get(account, 1000) + rng.randrange(-120, 125))
        rows.append((account, days(n), D(value[account])))
    return rows


def plain_drawdowns(rows):
    out = []
    for account in {r[0] for r in rows}:
        own, at = [r[1:] for r in rows if r[0] == account], 0
        while at < len(own):
            end = at + 1
            while end < len(own) and own[end][1] < own[at][1]:
                end += 1
            under = own[at + 1:end]
            if under:
                low = min(under, key=lambda r: (r[1], r[0]))
                out.append((account, own[at][0], own[at][1], low[0], low[1], own[end][0] if end < len(own) else None, len(under)))
            at = end
    return sorted(out, key=repr)


def plain_halts(rows, resets, loss, depth):
    out = []
    for account in {r[0] for r in rows}:
        last = peak = tripped = None
        marks = sorted([(d, 1, v) for a, d, v in rows if a == account] + [(d, 0, None) for a, d in set(resets) if a == account])
        for day, kind, value in marks:
            if kind == 0:
                if tripped:
                    out.append((account, day, "reset", None))
                last = peak = tripped = None
                continue
            reason = None
            if last is not None and float(last - value) >= loss * float(last):
                reason = "daily_loss"
            elif peak is not None and float(peak - value) >= depth * float(peak):
                reason = "drawdown"
            if reason and not tripped:
                out.append((account, day, "tripped", reason))
                tripped = True
            last, peak = value, value if peak is None else max(peak, value)
    return sorted(out, key=repr)


@pytest.mark.parametrize("slices", [month, lambda: F.col("session"), lambda: F.lit(1)])
def test_drawdowns_and_halts_of_a_hot_account(spark, slices):
    rng = random.Random(4)
    rows = equity_rows(rng)
    equity = spark.createDataFrame(rows, "account string, session date, equity decimal(20,2)")
    got = P.drawdowns(equity, ["account"], slices()).drop("drawdown")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_drawdowns(rows)
    resets = [(rng.choice(["hot", "a", "nobody"]), days(rng.randrange(400))) for _ in range(25)]
    found = H.halts(equity, spark.createDataFrame(resets, "account string, session date"), ["account"], F.lit(0.1), F.lit(0.25), slices())
    expected = plain_halts(rows, resets, 0.1, 0.25)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == expected
    assert {e[2:] for e in expected} == {("tripped", "daily_loss"), ("tripped", "drawdown"), ("reset", None)}


def test_holding_periods_pair_first_units_first(spark):
    rng = random.Random(8)
    fills = [("hot" if rng.random() < 0.6 else "b", days(rng.randrange(90)), n, rng.choice([-3, -1, 2, 4]), D(rng.randrange(1, 9))) for n in range(200)] + [("open", days(1), 900, 5, D(2))]
    got = P.holding_periods(spark.createDataFrame(fills, "account string, session date, seq long, quantity long, price decimal(18,2)"), ["account"], ["session", "seq"], month())
    for r in got.collect():
        own = sorted((f for f in fills if f[0] == r["account"]), key=lambda f: f[1:3])
        units = {side: [f[1] for f in own for _ in range(side * f[3])] for side in (1, -1)}
        pairs = list(zip(units[1], units[-1]))
        assert (r["closed_quantity"], r["open_quantity"], r["trades"]) == (len(pairs), len(units[1]) - len(units[-1]), len(own))
        assert r["mean_days_held"] == (sum((s - b).days for b, s in pairs) / len(pairs) if pairs else None)
        assert r["traded_value"] == sum(abs(f[3]) * f[4] for f in own)


def test_cost_sweep(spark):
    fills = spark.createDataFrame([("a", "X", 1, 10), ("a", "X", 2, -4), ("b", "Y", 1, 1)], "account string, symbol string, place long, quantity long")
    prices = spark.createDataFrame([("X", 1, D("10.5")), ("X", 2, D(11)), ("X", 3, D(12)), ("Y", 1, D(5))], "symbol string, place long, price decimal(18,2)")
    scenarios = [P.Scenario("free", 0, "0", 0), P.Scenario("dear", 100, "1", 0), P.Scenario("late", 0, "0", 1)]
    got = {(r["account"], r["scenario"]): (r["cash"], r["fills"], r["unpriced"]) for r in P.cost_sweep(fills, prices, ["account"], scenarios).collect()}
    assert got == {("a", "free"): (D(-61), 2, 0), ("a", "dear"): (D("-61") - D("1.05") - D("0.44") - 2, 2, 0), ("a", "late"): (D(-110 + 48), 2, 0),
                   ("b", "free"): (D(-5), 1, 0), ("b", "dear"): (D("-6.05"), 1, 0), ("b", "late"): (None, 1, 1)}


def bars(spark, closes, symbol="X"):
    return spark.createDataFrame([(symbol, days(n), D(str(v))) for n, v in enumerate(closes)], "symbol string, session date, close decimal(24,8)")


def test_trend_by_hand(spark):
    """Upward, downward, crossing and flat sequences; warm-up abstains, a tie is its own answer."""
    got = {s: [r["signal"] for r in G.trend_signals(bars(spark, v), 2, 3, 2, F.lit(0)).orderBy("session").collect()]
           for s, v in {"up": [1, 2, 3, 4], "down": [4, 3, 2, 1], "flat": [5, 5, 5], "cross": [1, 2, 3, 1, 1], "short": [1, 2]}.items()}
    assert got == {"up": ["warmup", "warmup", "above", "above"], "down": ["warmup", "warmup", "below", "below"], "flat": ["warmup", "warmup", "tie"],
                   "cross": ["warmup", "warmup", "above", "tie", "below"], "short": ["warmup", "warmup"]}


def test_zero_and_undefined_volatility_take_no_weight(spark):
    steady = G.trend_signals(bars(spark, [1, 2, 4, 8, 16]), 1, 2, 3, F.lit(0))
    early = G.trend_targets(steady, 0.1, 1.0).orderBy("session").collect()
    assert [(r["reason"], r["weight"]) for r in early] == [("warmup", 0), ("undefined_volatility", 0), ("undefined_volatility", 0), ("zero_volatility", 0), ("zero_volatility", 0)]
    both = steady.unionByName(G.trend_signals(bars(spark, [10, 11, 12, 13.5, 14], "Y"), 1, 2, 3, F.lit(0)))
    last = {r["symbol"]: r for r in G.trend_targets(both, 1.0, 0.5).where(F.col("session") == days(4)).collect()}
    assert (last["X"]["weight"], last["Y"]["reason"], last["Y"]["weight"]) == (0, "capped", 0.25)
    assert G.trend_targets(both, 0.001, 0.5).where("symbol = 'Y'").orderBy(F.desc("session")).first()["reason"] == "scaled"


@pytest.mark.parametrize("block", [1, 50, 65_536])
def test_signals_of_a_hot_symbol_do_not_look_ahead(spark, block):
    rng = random.Random(1)
    closes = [round(50 + rng.random() * 10, 2) for _ in range(300)]
    whole = G.trend_signals(bars(spark, closes), 3, 8, 5, month(), block).orderBy("session").collect()
    cut = G.trend_signals(bars(spark, closes[:200]), 3, 8, 5, month(), block).orderBy("session").collect()
    assert whole[:200] == cut
    for n, r in enumerate(whole):
        prices = [D(str(x)) for x in closes[:n + 1]]
        returns = [int(b * 10**9 // a) - 10**9 for a, b in zip(prices, prices[1:])][-5:]
        fast, slow = sum(prices[-3:]) * 8, sum(prices[-8:]) * 3
        assert r["signal"] == ("warmup" if n < 7 else "above" if fast > slow else "below" if fast < slow else "tie")
        if len(returns) == 5:
            mean = sum(returns) / 5
            assert math.isclose(r["volatility"], math.sqrt(sum((x - mean) ** 2 for x in returns) / 4) / 1e9, rel_tol=1e-6)
        else:
            assert r["volatility"] is None


def test_labels_mature_and_purge(spark):
    rng = random.Random(2)
    sessions = spark.createDataFrame([(days(n),) for n in range(100) if days(n).weekday() < 5], "session date")
    rows = [(s, days(n), D(rng.randrange(1, 99)), datetime.combine(days(n), datetime.min.time()) + timedelta(hours=21)) for s in "AB" for n in range(100) if rng.random() < 0.95]
    df = spark.createDataFrame(rows, "symbol string, session date, open decimal(24,8), available_at timestamp")
    cutoff = datetime.combine(days(80), datetime.min.time())
    labels = Y.forward_labels(df, sessions, 3, F.lit(cutoff)).collect()
    order = [days(n) for n in range(100) if days(n).weekday() < 5]
    known = {(r[0], r[1]): r for r in rows}
    assert len(labels) == sum(r[1].weekday() < 5 for r in rows)
    for r in labels:
        at = order.index(r["session"])
        entry, out = (known.get((r["symbol"], order[at + k])) if at + k < len(order) else None for k in (1, 4))
        status = "no_entry" if not entry else "no_exit" if not out else "immature" if out[3] > cutoff else "ready"
        assert r["status"] == status
        assert r["forward_return"] == (float(out[2]) / float(entry[2]) - 1 if status == "ready" else None)
    frame = Y.forward_labels(df, sessions, 3, F.lit(cutoff))
    for keys in ((), ("symbol",)):
        held = F.col("session").between(days(30), days(36)) if not keys else F.col("session").between(days(30), days(36)) & (F.col("symbol") == "A")
        parts = Y.purged_split(frame, held, keys).collect()
        test = [p for p in parts if p["part"] == "test"]
        assert test and len(parts) == sum(r["status"] == "ready" for r in labels)
        for p in parts:
            met = any(t["label_start"] <= p["label_end"] and t["label_end"] >= p["label_start"] and (not keys or t["symbol"] == p["symbol"]) for t in test)
            assert p["part"] == "test" or (p["part"] == "purged") == met
        assert {p["part"] for p in parts} == {"train", "purged", "test"}


def test_share_deltas_by_hand(spark):
    """Ten of X, then what is left for Y, nothing for Z; a sale, an open order that covers, a cut, and what cannot be ordered."""
    targets = [("a", "X", "0.5", "100", 0, 0), ("a", "Y", "0.4", "90", 0, 0), ("a", "Z", "0.1", "50", 0, 0), ("a", "S", "0", "10", 7, 0), ("a", "P", "0.02", "10", 0, 4),
               ("a", "N", "0.1", None, 0, 0), ("a", "F", "0", "1", 90, 0), ("none", "X", "1", "1", 0, 0)]
    frame = spark.createDataFrame([(a, s, D(w), p and D(p), h, q) for a, s, w, p, h, q in targets], "account string, symbol string, weight decimal(5,4), price decimal(18,2), held long, pending long")
    accounts = spark.createDataFrame([("a", D(2000), D(1250))], "account string, equity decimal(20,2), cash decimal(20,2)")
    for slices in (F.lit(0), F.floor(F.col("__rank") / 100)):
        got = {(r["account"], r["symbol"]): tuple(r)[2:] for r in N.share_deltas(frame, accounts, 100, F.lit(1).cast("decimal(10,2)"), F.lit(50), slices).collect()}
        assert got == {("a", "X"): (10, 10, D(1011), "buy"), ("a", "Y"): (8, 2, D("182.8"), "cash"), ("a", "Z"): (4, 0, D(0), "no_cash"), ("a", "S"): (-7, -7, D(0), "sell"),
                       ("a", "P"): (0, 0, D(0), "covered"), ("a", "N"): (None, 0, D(0), "invalid_price"), ("a", "F"): (-90, -50, D(0), "max_order"), ("none", "X"): (None, 0, D(0), "no_account")}


def test_no_account_overspends(spark):
    rng = random.Random(5)
    rows = [(a, f"s{n}", D(rng.randrange(1, 60)) / 100, D(rng.randrange(100, 9000)) / 100, rng.randrange(5), rng.randrange(-2, 3)) for a in "abc" for n in range(40)]
    frame = spark.createDataFrame(rows, "account string, symbol string, weight decimal(5,4), price decimal(18,2), held long, pending long")
    accounts = spark.createDataFrame([(a, D(100_000), D(cash)) for a, cash in (("a", 60_000), ("b", 500), ("c", 0))], "account string, equity decimal(20,2), cash decimal(20,2)")
    orders = N.share_deltas(frame, accounts, 25, F.lit(2).cast("decimal(10,2)"), F.lit(10_000), F.lit(0)).collect()
    spent = {a: sum(r["cost"] for r in orders if r["account"] == a) for a in "abc"}
    assert len(orders) == 120 and 59_000 < spent["a"] <= 60_000 and 0 < spent["b"] <= 500 and spent["c"] == 0
    assert all((r["reason"] in ("buy", "sell", "covered")) == (r["quantity"] == r["wanted"]) for r in orders)


def test_category_rates(spark):
    rng = random.Random(6)
    rows = [(n, rng.choice(["x", "y", None]), rng.choice(["p", "q"]), rng.choice(K.OUTCOMES), rng.choice([True, False, None])) for n in range(400)] + [(900, "alone", "p", "unknown", None), (901, "x", "p", "odd", True)]
    df = spark.createDataFrame(rows, "id long, a string, b string, outcome string, supported boolean")
    got = {(r["a"], r["b"], r["together"]): r for r in K.category_rates(df, ["a", "b"], "id").collect()}
    again = K.category_rates(df.repartition(7), ["a", "b"], "id").collect()
    assert {(r["a"], r["b"], r["together"]): r for r in again} == got and len(got) == 3 * 2 + 1 + 4 + 2 + 1

    def weight(i, r):
        place = int(hashlib.md5(f"{i}/{r}/1".encode()).hexdigest()[:8], 16)
        return sum(place >= e for e in K.poisson_edges())

    for (a, b, together), r in got.items():
        held = {0: lambda x: x[1:3] == (a, b), 1: lambda x: x[1] == a if b is None else x[2] == b, 2: lambda x: True}[together]  # noqa: B023
        own = [x for x in rows if x[3] in K.OUTCOMES and held(x)]
        counts = [sum(x[3] == o for x in own) for o in K.OUTCOMES]
        assert (r["answers"], [r[o] for o in K.OUTCOMES]) == (len(own), counts)
        known = [x for x in own if x[3] in ("correct", "wrong")]
        assert r["accuracy"] == (counts[0] / len(known) if known else None) and r["support_rate"] == (sum(x[4] is True for x in known) / len(known) if known else None)
        drawn = [(sum(weight(x[0], n) for x in known if x[3] == "correct"), sum(weight(x[0], n) for x in known)) for n in range(K.REPLICATES)]
        rates = sorted(c / d for c, d in drawn if d)
        tail = len(rates) // 40
        assert (r["low"], r["high"]) == ((rates[tail], rates[-1 - tail]) if rates else (None, None))
    whole = got[None, None, 2]
    assert whole["low"] < whole["accuracy"] < whole["high"]
    mean = sum(weight(i, r) for i in range(300) for r in range(20)) / 6000
    assert abs(mean - 1) < 0.05


def test_scenarios_share_their_sums(spark):
    """Twenty scenarios of two delays need two sums each, and lose no digit of a price."""
    from asofmill.operators import performance

    scenarios = [performance.Scenario(f"{bps}/{commission}/{delay}", bps, commission, delay) for bps in (0, 1, 7, 25, 33) for commission in ("0", "0.35") for delay in (0, 1)]
    fills = spark.createDataFrame([("a", "X", 1, 3), ("a", "X", 2, -7), ("a", "X", 3, 1)], "account string, symbol string, place long, quantity long")
    prices = spark.createDataFrame([("X", 1, "10.0001"), ("X", 2, "11.0003")], "symbol string, place long, price string").withColumn("price", F.col("price").cast("decimal(18,4)"))
    found = performance.cost_sweep(fills, prices, ["account"], scenarios)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("sum(") <= 4
    price = {1: Decimal("10.0001"), 2: Decimal("11.0003")}
    for row in found.collect():
        bps, commission, delay = row["scenario"].split("/")
        known = [(q, price[p + int(delay)]) for p, q in ((1, 3), (2, -7), (3, 1)) if p + int(delay) in price]
        assert row["cash"] == sum(-q * p - abs(q) * p * int(bps) / 10_000 - Decimal(commission) for q, p in known) and row["unpriced"] == 3 - len(known)

"""Plans that must not repeat work: what is read or sorted more often than needed grows beyond memory and time on large tables."""

import random
import re
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from asofmill.operators import labels as Y
from asofmill.operators import performance as P
from asofmill.operators import signals as G
from asofmill.operators.context import eligible_context
from asofmill.operators.experiments import binding_violations
from asofmill.operators.portfolio import exposure_violations

DAY = date(2024, 1, 1)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_labels_sort_no_copies_of_bars(spark):
    """Maxima of structs sorted three rows per bar; frames need one. Blocks that are shorter than the calendar, a repeated bar, null prices."""
    rng = random.Random(3)
    days = [DAY + timedelta(days=n) for n in range(40)]
    bars = [(s, d, rng.choice([None, float(rng.randrange(1, 9))]), d) for s in ("A", "B", None) for d in days if rng.random() < 0.8]
    given = spark.createDataFrame(bars + bars[:3], "symbol string, session date, open double, available_at date")
    got = Y.forward_labels(given, spark.createDataFrame([(d,) for d in days], "session date"), 3, F.lit(days[30]), block=5)
    at = {(s, d): o for s, d, o, _ in bars}
    expected = set()
    for s, d, _, _ in bars:
        entry, last = ((s, d + timedelta(days=n)) for n in (1, 4))
        status = "no_entry" if entry not in at else "no_exit" if last not in at else "immature" if last[1] > days[30] else "ready"
        change = at[last] / at[entry] - 1 if status == "ready" and at[last] is not None and at[entry] else None
        expected.add((s, d, entry[1] if entry in at else None, last[1] if last in at else None, status, change))
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(expected) and set(rows) == expected
    assert "SortAggregate" not in plan(got)


def test_drawdowns_join_nothing(spark):
    rng = random.Random(4)
    rows = [(k, DAY + timedelta(days=17 * n), rng.choice([1, 2, 3, 3, 4])) for k in (1, None) for n in range(120)]
    got = P.drawdowns(spark.createDataFrame(rows, "account int, session date, equity int"), ["account"], F.date_trunc("YEAR", "session"))
    expected = set()
    for k in (1, None):
        own = [r[1:] for r in rows if r[0] == k]
        opens = [n for n in range(len(own)) if all(own[n][1] >= v for _, v in own[:n])]
        for a, b in zip(opens, opens[1:] + [len(own)]):
            if b - a > 1:
                low = min((v, d) for d, v in own[a:b])
                expected.add((k, *own[a], low[1], low[0], own[b][0] if b < len(own) else None, b - a - 1))
    found = [(r.account, r.peak_session, r.peak, r.trough_session, r.trough, r.recovery_session, r.sessions_under) for r in got.collect()]
    assert len(found) == len(expected) and set(found) == expected
    assert "Join" not in plan(got)


def test_trend_sums_do_not_slide(spark):
    """A frame that slides adds up its whole width for every row."""
    bars = spark.createDataFrame([("A", DAY + timedelta(days=n), float(1 + n % 5)) for n in range(30)], "symbol string, session date, close double")
    got = G.trend_signals(bars, 3, 5, 4, F.date_trunc("YEAR", "session"), block=7)
    assert not re.search(r"RowFrame, -\d+, currentrow", plan(got))
    rows = got.orderBy("session").collect()
    mean = lambda n, k: sum(1 + m % 5 for m in range(n - k + 1, n + 1)) / k
    for n, r in enumerate(rows):
        assert r.signal == ("warmup" if n < 4 else "above" if mean(n, 3) > mean(n, 5) else "below" if mean(n, 3) < mean(n, 5) else "tie")


@pytest.mark.parametrize("closes,signal", [([1.0, 2.0, None, None, None], "tie"), ([None] * 5, "tie"), ([1.0, None, None, None, 2.0], "above")])
def test_frames_without_closes_have_no_mean(spark, closes, signal):
    bars = spark.createDataFrame([("A", DAY + timedelta(days=n), v) for n, v in enumerate(closes)], "symbol string, session date, close double")
    got = G.trend_signals(bars, 3, 5, 4, F.date_trunc("YEAR", "session"))
    assert got.orderBy(F.desc("session")).first().signal == signal


def test_portfolio_rules_in_one_join(spark):
    """Odd rows: no cash, no portfolio, no symbol, repeated holdings and intentions; holdings are read once."""
    early, late = datetime(2024, 1, 1), datetime(2024, 2, 1)
    cash = spark.createDataFrame([(1, 10, late), (2, -1, late), (3, 5, early), (5, 0, None)], "portfolio int, cash_usd int, as_of timestamp").withColumn(
        "cash_usd", F.col("cash_usd").cast("decimal(18,2)")).withColumn("dividend_receivable_usd", F.col("cash_usd"))
    holdings = spark.createDataFrame(
        [(1, "A", 5, early), (1, "A", 1, early), (3, "A", 2, late), (4, "A", 9, late), (None, "A", 7, late), (1, None, 7, early), (5, "A", 1, late)],
        "portfolio int, symbol string, quantity long, marked_at timestamp")
    pending = spark.createDataFrame(
        [(1, 1, "A", "sell", 6, 0), (1, 2, "A", "buy", 9, 11), (1, None, None, "sell", 1, 0), (4, 1, "A", "sell", 10, 1), (4, 1, "B", "buy", 1, 1), (None, 1, "A", "sell", 1, 0)],
        "portfolio int, intention_id int, symbol string, side string, remaining_quantity long, reserved_cash_usd int").withColumn(
        "reserved_cash_usd", F.col("reserved_cash_usd").cast("decimal(18,2)"))
    got = exposure_violations(cash, holdings, pending)
    assert len(re.findall(r"Join", plan(got))) == 1
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [
        (1, "duplicate_holding"), (1, "reservations_exceed_cash"), (1, "sells_exceed_holding"), (2, "reservations_exceed_cash"), (3, "mark_after_as_of"),
        (4, "duplicate_intention"), (4, "sell_reserves_cash"), (4, "sells_exceed_holding"), (None, "sells_exceed_holding")]))


def test_context_items_meet_their_decision_once(spark):
    """A decision given twice, one that is unknown, rows that repeat, null keys; every item is joined with its decision and nothing else."""
    at = lambda n: datetime(2024, 1, n)
    row = (1, "paper", at(5), datetime(2024, 1, 6, 15), date(2024, 1, 6), at(7), at(5), [0], "s1", ["a"], None, None)
    contexts = spark.createDataFrame([row, row], "context_id long, mode string, decision_at timestamp, execution_at timestamp, execution_session date, "
                                     "target_expires_at timestamp, portfolio_as_of timestamp, dataset_ids array<long>, feature_schema_id string, "
                                     "feature_names array<string>, model_trained_through timestamp, model_created_at timestamp")
    universe = spark.createDataFrame([(1, "A"), (1, "A"), (2, None)], "context_id long, symbol string").withColumns(
        {"listed_on": F.lit(date(2023, 1, 1)), "delisted_on": F.lit(None).cast("date")})
    day = date(2024, 1, 2)
    observations = spark.createDataFrame(
        [(1, "A", day, 0, at(3), at(4)), (1, "A", day, 0, at(2), at(4)), (1, "B", day, 0, at(3), at(4)), (1, None, day, 0, at(3), at(4)), (2, "A", day, 0, at(9), at(9))],
        "context_id long, symbol string, session date, dataset_id long, available_at timestamp, first_ingested_at timestamp").withColumn("origin", F.lit("x"))
    features = spark.createDataFrame(
        [(1, "A", day, 0, at(1), at(5)), (1, "A", date(2024, 1, 3), 0, at(3), at(5)), (1, None, day, 0, at(3), at(5)), (2, "A", day, 0, at(9), at(8))],
        "context_id long, symbol string, session date, dataset_id long, available_at timestamp, computed_at timestamp").withColumns(
        {"adjusted_as_of": F.lit(at(1)), "feature_schema_id": F.lit("s1"), "names": F.array(F.lit("a"))})
    got = eligible_context(contexts, universe, observations, features)
    assert len(re.findall(r"Join", plan(got))) == 1
    expected = ([(1, "A", "duplicate_instrument"), (1, "A|2024-01-02", "duplicate_observation"), (1, "A|2024-01-02", "no_observation"),
                 (1, "A|2024-01-03", "no_observation"), (1, "2024-01-02", "no_observation"), (2, "A|2024-01-02", "computed_before_ingestion")]
                + [(1, "B|2024-01-02", "undeclared")] * 2 + [(1, "2024-01-02", "undeclared")] * 4)
    assert sorted(map(tuple, got.collect())) == sorted(expected)


def test_bindings_sort_no_rows(spark):
    """Unknown contexts, datasets and experiments, null keys, a dataset that is declared twice with different properties."""
    day = date(2024, 1, 2)
    contexts = spark.createDataFrame([(1, 1, 1, "backtest", day, [0]), (2, 9, 1, "backtest", day, [0]), (3, None, None, None, None, None)],
                                     "context_id long, experiment_id long, run_id long, mode string, execution_session date, dataset_ids array<long>")
    experiments = spark.createDataFrame([(1, 1, "backtest", day, day)], "experiment_id long, run_id long, mode string, start_session date, end_session date")
    names = "kind string, origin string, provider string, feed string, revision_policy string"
    datasets = spark.createDataFrame([(1, 0, "market", "o", "p", "f", "r"), (1, 1, "market", "o", "p", "f", "r"), (1, 1, "market", "o", "p", "g", "r")],
                                     f"experiment_id long, dataset_id long, {names}")
    rows = lambda *given: spark.createDataFrame(given, f"context_id long, dataset_id long, {names}").drop("kind")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = {}
        for dataset in (0, 1, None):
            got = binding_violations(contexts, experiments, datasets, rows((1, dataset, "", "o", "p", "f", "r"), (7, 0, "", "x", "p", "f", "r")))
            assert "SortMergeJoin" not in plan(got) and "ShuffledHashJoin" in plan(got)
            found[dataset] = {r.reason for r in got.where("context_id = 1").collect()}
        others = {(r.context_id, r.reason) for r in got.where("context_id <> 1").collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert found == {0: {"dataset_ids"}, 1: {"dataset_ids", "observation_provenance"}, None: {"dataset_ids", "observation_provenance"}}
    wrong = {"different_run", "different_mode", "outside_range", "dataset_ids"}
    assert others == {(2, r) for r in wrong} | {(3, "outside_range")}

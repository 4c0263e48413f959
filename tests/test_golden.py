"""Hand-worked results."""

from datetime import date, datetime
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from asofmill.operators import bars as B
from asofmill.operators import calendars as K
from asofmill.operators import capture as C
from asofmill.operators import ledger as L
from asofmill.operators import pointintime as P
from asofmill.operators import portfolio as X
from asofmill.operators import scoring as S

from . import fixtures as T


def test_minutes_to_daily_bars(spark):
    pages = T.pages_frame(spark, T.bar_pages())
    assert pages.count() == 4
    universe = T.universe(spark).unionByName(T.universe(spark, "ZZTEST"))
    sessions = T.sessions(spark, T.DAYS[1:3])
    judged = C.classify_minutes(C.minute_rows(pages), sessions, universe)
    assert judged.count() == 1200
    assert judged.where("reject_reason is not null").count() == 0
    found = B.regular_bars(judged.drop("session"), sessions, "p", "sip", "synthetic")
    assert T.key_set(found, "symbol", "session", "open", "high", "low", "close", "volume") == [
        ("BBTEST", date(2024, 7, 2), D(100), D(110), D(90), D(105), 3900),
        ("BBTEST", date(2024, 7, 3), D(52), D(56), D(51), D(55), 4200),
        ("ZZTEST", date(2024, 7, 2), D(200), D(212), D(198), D(210), 11700),
        ("ZZTEST", date(2024, 7, 3), D(211), D(215), D(209), D(213), 8400),
    ]
    first = found.orderBy("symbol", "session").first()
    assert first["available_at"] == datetime(2024, 7, 2, 20, 15)
    assert len(first["revision_id"]) == 64


def test_revision_id_is_the_hash_of_canonical_minutes(spark):
    import hashlib
    import json

    rows = [r for s, r in T.minute_records(T.SEEDS[1])]
    text = "".join(
        json.dumps({"t": r["t"].replace("Z", ".000000Z"), "v": r["v"], **{k: str(r[k]) for k in "ohlc"}}, sort_keys=True,
                   separators=(",", ":")) for r in rows
    )
    pages = T.pages_frame(spark, [p for p in T.bar_pages() if "07-03" in p[1]])
    sessions = T.sessions(spark, T.DAYS[2:3])
    universe = T.universe(spark).unionByName(T.universe(spark, "ZZTEST"))
    judged = C.classify_minutes(C.minute_rows(pages), sessions, universe).drop("session")
    bar = B.regular_bars(judged, sessions, "p", "sip", "synthetic").where("symbol = 'BBTEST'").first()
    assert bar["revision_id"] == hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("cutoff, closes", [
    ("2024-07-02 20:15:00", [D(105), D(112)]), ("2024-07-03 17:15:00", [D("52.5"), D(56), D(57)]),
    ("2024-07-03 13:29:59", [D(105), D(112)]), ("2024-07-03 13:30:00", [D("52.5"), D(56)]),
])
def test_split_adjusted_view(spark, cutoff, closes):
    view = P.split_adjusted_view(T.bars(spark), T.actions(spark), T.sessions(spark), T.lit_time(cutoff))
    assert [r["close"] for r in view.orderBy("session").collect()] == closes


def test_adjusted_rows_become_available_with_their_split(spark):
    view = P.split_adjusted_view(T.bars(spark), T.actions(spark), T.sessions(spark), T.lit_time("2024-07-09 23:00:00"))
    rows = view.orderBy("session").collect()
    assert rows[0]["available_at"] == datetime(2024, 7, 3, 13, 30)
    assert rows[2]["available_at"] == datetime(2024, 7, 3, 17, 15)


def test_late_split_fails(spark):
    late = T.action_rows()
    late[0]["available_at"] = datetime(2024, 7, 5)
    with pytest.raises(Exception, match="not available"):
        P.split_adjusted_view(T.bars(spark), T.actions(spark, late), T.sessions(spark), T.lit_time("2024-07-03 17:15:00")).collect()


def test_coverage_report(spark):
    row = B.coverage_report(T.bars(spark)).collect()
    assert [tuple(r) for r in row] == [("BBTEST", 6, date(2024, 7, 1), date(2024, 7, 9), 0)]


def test_closures_and_shortened_sessions(spark):
    assert [r[0].day for r in K.closures(T.sessions(spark)).orderBy("closed_on").collect()] == [4, 6, 7]
    assert [r[0].day for r in K.shortened(T.sessions(spark)).collect()] == [3]


def test_completed_features_in_units_of_now(spark):
    features = T.bars(spark).select("symbol", "session", "available_at", F.col("close").alias("feature_close"))
    splits = P.effective_splits(T.actions(spark), T.sessions(spark), T.lit_time("2024-07-03 13:30:00"))
    visible = P.completed_features(features, splits, T.lit_time("2024-07-03 13:30:00"))
    assert [(r["session"].day, r["feature_close"]) for r in visible.orderBy("session").collect()] == [(1, D("52.5")), (2, D(56))]


def _ledger(spark, fills, dividends=None, snapshots=None, hot_rows=None):
    columns = "account string, symbol string, session date, seq bigint, quantity bigint, price decimal(18,8), commission decimal(18,8)"
    frame = spark.createDataFrame(fills, columns)
    splits = T.actions(spark).where("kind = 'split'").select("symbol", "effective_session", "split_ratio")
    raw = spark.createDataFrame([("BBTEST", "d1", date(2024, 7, 5), D(1), date(2024, 7, 9))] if dividends is None else dividends,
                                "symbol string, action_id string, ex_session date, amount decimal(18,8), pay_date date")
    marks = T.bars(spark).select("symbol", "session", F.col("open").alias("mark"))
    paid = L.payment_sessions(raw, T.sessions(spark))
    options = {} if hot_rows is None else {"hot_rows": hot_rows, "slice_by": F.col("session")}
    ledger = L.ledger_replay(frame, splits, paid, marks, F.lit(10000), snapshots, **options)
    return ledger.orderBy("session", "rank", "seq").collect()


BUY = ("a", "BBTEST", date(2024, 7, 2), 1, 10, D("110.11"), D(1))
SELL = ("a", "BBTEST", date(2024, 7, 8), 2, -20, D("59.94"), D(1))


@pytest.mark.parametrize("hot_rows", [None, 1])
def test_ledger(spark, hot_rows):
    rows = _ledger(spark, [BUY, SELL], hot_rows=hot_rows)
    assert [(r["event"], r["cash"], r["position"], r["receivable"], r["equity"]) for r in rows] == [
        ("fill", D("8897.9"), 10, D(0), D("9997.9")), ("split", D("8897.9"), 20, D(0), D("10017.9")),
        ("entitlement", D("8897.9"), 20, D(20), D("10037.9")), ("fill", D("10095.7"), 0, D(20), D("10115.7")),
        ("payment", D("10115.7"), 0, D(0), D("10115.7")),
    ]


def test_ledger_at_session_opens(spark):
    opens = spark.createDataFrame([("a", "BBTEST", d) for d in T.DAYS], "account string, symbol string, session date")
    rows = [r for r in _ledger(spark, [BUY, SELL], snapshots=opens) if r["event"] == "open"]
    assert [r["cash"] for r in rows] == [D(x) for x in ("10000", "10000", "8897.9", "8897.9", "8897.9", "10115.7")]
    assert [r["position"] for r in rows] == [0, 0, 20, 20, 20, 0]
    assert [r["receivable"] for r in rows] == [0, 0, 0, 20, 20, 0]
    assert [r["equity"] for r in rows] == [D(x) for x in ("10000", "10000", "10017.9", "10037.9", "10117.9", "10115.7")]


def test_buyer_on_the_ex_date_gets_no_dividend(spark):
    # Enter on the ex-date: 20 x 56.06, leave at 59.94, no entitlement.
    fills = [("a", "BBTEST", date(2024, 7, 5), 1, 10, D("56.06"), D(1)), ("a", "BBTEST", date(2024, 7, 8), 2, -10, D("59.94"), D(1))]
    rows = _ledger(spark, fills)
    assert [r["event"] for r in rows] == ["fill", "fill"]
    assert rows[-1]["cash"] == D("10036.8")


def test_ledger_without_costs_of_spread(spark):
    rows = _ledger(spark, [(*BUY[:5], D(110), D(1)), (*SELL[:5], D(60), D(1))])
    assert rows[-1]["cash"] == D("10118")


def test_unpaid_dividend_beyond_the_calendar_stays_receivable(spark):
    rows = _ledger(spark, [BUY, SELL], [("BBTEST", "d1", date(2024, 7, 5), D(1), date(2024, 8, 1))])
    assert (rows[-1]["event"], rows[-1]["receivable"], rows[-1]["equity"]) == ("fill", D(20), D("10115.7"))


def test_average_price_follows_the_split(spark):
    columns = "account string, symbol string, session date, seq bigint, quantity bigint, price decimal(18,8), commission decimal(18,8)"
    splits = T.actions(spark).where("kind = 'split'").select("symbol", "effective_session", "split_ratio")
    rows = L.average_buy_price(spark.createDataFrame([BUY, SELL], columns), splits).orderBy("session").collect()
    assert [r["average_price"] for r in rows] == [D("110.11"), D("55.055")]


def test_exposure(spark):
    cash = spark.createDataFrame([("p", D(1000), D(10), datetime(2024, 7, 3))],
                                 "portfolio string, cash_usd decimal(24,8), dividend_receivable_usd decimal(24,8), as_of timestamp")
    holdings = spark.createDataFrame([("p", "BBTEST", 10, D(106), datetime(2024, 7, 3))],
                                     "portfolio string, symbol string, quantity bigint, raw_mark_usd decimal(24,8), marked_at timestamp")
    pending = spark.createDataFrame([("p", "i1", "BBTEST", "buy", 2, D(220)), ("p", "i2", "BBTEST", "sell", 4, D(0))],
                                    "portfolio string, intention_id string, symbol string, side string, remaining_quantity bigint, reserved_cash_usd decimal(24,8)")
    assert X.equity(cash, holdings).first()["equity_usd"] == 2070
    assert X.spendable(cash, pending).first()["spendable_cash_usd"] == 780
    assert X.exposure_violations(cash, holdings, pending).count() == 0
    more = pending.withColumn("remaining_quantity", F.lit(11)).withColumn("reserved_cash_usd", F.lit(D(600)))
    assert [r[1] for r in X.exposure_violations(cash, holdings, more).orderBy("reason").collect()] == [
        "reservations_exceed_cash", "sell_reserves_cash", "sells_exceed_holding"]


def test_ridge_score(spark):
    training = spark.createDataFrame([(50.0, 0.0), (75.0, 0.25), (100.0, 0.5), (125.0, 0.75)], "x double, y double")
    rows = spark.createDataFrame([(105.0,), (56.0,)], "x double")
    parameters = S.ridge_parameters(training, "x", "y")
    scored = rows.select(S.ridge_score(rows, parameters, "x").alias("p")).collect()
    assert [round(r[0], 12) for r in scored] == [0.515, 0.123]


def test_ridge_pipeline_agrees_with_the_closed_form(spark):
    import statistics

    data = [(50.0, 0.0), (75.0, 0.25), (100.0, 0.5), (125.0, 0.75)]
    training = spark.createDataFrame(data, "x double, y double")
    deviation = statistics.pstdev(y for _, y in data)
    model = S.ridge_pipeline(["x"], "y", 1.0, 4, deviation).fit(training)
    scored = model.transform(spark.createDataFrame([(105.0,), (56.0,)], "x double")).collect()
    assert [round(r["prediction"], 9) for r in scored] == [0.515, 0.123]

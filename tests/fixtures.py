"""Hand-typed market of one fabricated symbol: six sessions, one split, one dividend."""

from __future__ import annotations

from datetime import date, datetime, timedelta
from decimal import Decimal

from pyspark.sql import functions as F

from asofmill.operators.quality import Plan

D = Decimal
DAYS = [date(2024, 7, 1), date(2024, 7, 2), date(2024, 7, 3), date(2024, 7, 5), date(2024, 7, 8), date(2024, 7, 9)]
PRICES = [(100, 106, 99, 105), (110, 113, 109, 112), (56, 58, 55, 57), (56, 59, 55, 58), (60, 62, 59, 61), (62, 64, 61, 63)]
INGESTED = datetime(2026, 9, 8)


def at(day, hour, minute=0):
    return datetime(day.year, day.month, day.day, hour, minute)


def close_of(day):
    return at(day, 17) if day == date(2024, 7, 3) else at(day, 20)


def sessions(spark, days=DAYS):
    rows = [(d, at(d, 13, 30), close_of(d)) for d in days]
    return spark.createDataFrame(rows, "session date, market_open timestamp, market_close timestamp")


def bar_rows():
    return [
        dict(schema_version=1, symbol="BBTEST", session=d, interval="1d", interval_start=at(d, 13, 30), interval_end=close_of(d),
             available_at=close_of(d) + timedelta(minutes=15), first_ingested_at=INGESTED, provider="fixture", feed="fixture",
             revision_id=f"r{i}", origin="synthetic", adjustment="raw", currency="USD", open=D(o), high=D(h), low=D(lo), close=D(c),
             volume=1_000_000, arrival=i)
        for i, (d, (o, h, lo, c)) in enumerate(zip(DAYS, PRICES))
    ]


BAR_SCHEMA = (
    "schema_version tinyint, symbol string, session date, interval string, interval_start timestamp, interval_end timestamp, "
    "available_at timestamp, first_ingested_at timestamp, provider string, feed string, revision_id string, origin string, "
    "adjustment string, currency string, open decimal(24,8), high decimal(24,8), low decimal(24,8), close decimal(24,8), "
    "volume bigint, arrival bigint"
)


def bars(spark, rows=None):
    names = [part.split()[0] for part in BAR_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in (bar_rows() if rows is None else rows)], BAR_SCHEMA)


def action_rows():
    return [
        dict(action_id="split-1", symbol="BBTEST", kind="split", effective_session=DAYS[2], available_at=at(DAYS[2], 13, 30),
             first_ingested_at=INGESTED, split_ratio=2, cash_amount_usd=None, pay_date=None, arrival=0),
        dict(action_id="dividend-1", symbol="BBTEST", kind="cash_dividend", effective_session=DAYS[3],
             available_at=at(DAYS[3], 13, 30), first_ingested_at=INGESTED, split_ratio=None, cash_amount_usd=D(1),
             pay_date=DAYS[5], arrival=1),
    ]


ACTION_SCHEMA = (
    "action_id string, symbol string, kind string, effective_session date, available_at timestamp, first_ingested_at timestamp, "
    "split_ratio bigint, cash_amount_usd decimal(24,8), pay_date date, arrival bigint"
)


def actions(spark, rows=None):
    names = [part.split()[0] for part in ACTION_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in (action_rows() if rows is None else rows)], ACTION_SCHEMA)


def universe(spark, symbol="BBTEST", listed=date(2024, 7, 1), delisted=None):
    return spark.createDataFrame([(symbol, "XNYS", listed, delisted)], "symbol string, exchange string, listed_on date, delisted_on date")


def plan(**changes):
    values = dict(
        origin="synthetic", provider="fixture", feed="fixture", coverage_start=DAYS[0], coverage_end=DAYS[-1],
        first_execution_session=DAYS[1], warmup_sessions=1, retrieved_at=INGESTED, revision_policy="point_in_time",
        limitations=("synthetic_data",),
    )
    return Plan(**{**values, **changes})


# Minute seeds: symbol, session, open time, minutes, open, high, low, close, volume per minute.
SEEDS = [
    ("BBTEST", date(2024, 7, 2), 390, 100, 110, 90, 105, 10), ("BBTEST", date(2024, 7, 3), 210, 52, 56, 51, 55, 20),
    ("ZZTEST", date(2024, 7, 2), 390, 200, 212, 198, 210, 30), ("ZZTEST", date(2024, 7, 3), 210, 211, 215, 209, 213, 40),
]


def minute_records(seed):
    symbol, day, count, o, h, lo, c, v = seed
    start = at(day, 13, 30)
    for i in range(count):
        prices = (o, h, lo, c) if i == 0 else (c, c, c, c)
        yield symbol, {
            "t": (start + timedelta(minutes=i)).isoformat() + "Z", "o": prices[0], "h": prices[1], "l": prices[2], "c": prices[3],
            "v": v, "n": 1, "vw": prices[3],
        }


def bar_pages(per_page=400):
    """(seq, start, received, {symbol: rows}, token) per page: one chain per session, pages of at most 400 rows."""
    pages = []
    for day in (date(2024, 7, 2), date(2024, 7, 3)):
        rows = [r for seed in SEEDS if seed[1] == day for r in minute_records(seed)]
        chunks = [rows[i:i + per_page] for i in range(0, len(rows), per_page)]
        for n, chunk in enumerate(chunks):
            body = {}
            for symbol, record in chunk:
                body.setdefault(symbol, []).append(record)
            token = f"{day}-{n + 1}" if n + 1 < len(chunks) else None
            pages.append([len(pages), f"{at(day, 13, 30).isoformat()}+00:00", datetime(2024, 7, 4, 0, len(pages)), body, token])
    return pages


def pages_frame(spark, pages, path="/v2/stocks/bars", group="bars"):
    import json

    rows = [("c", seq, path, {"start": start}, received, json.dumps({group: body, "next_page_token": token}))
            for seq, start, received, body, token in pages]
    return spark.createDataFrame(
        rows, "capture_id string, seq bigint, path string, params map<string,string>, received_at timestamp, body string"
    )


def key_set(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def lit_time(text):
    return F.lit(text).cast("timestamp")

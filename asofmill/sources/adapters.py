"""Views that let the operators run on the driver's tables, which are not market data themselves."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clocks import exchange_date
from ..functions.exact import number_text
from ..functions.identity import sha256
from ..functions.scans import Scan, running
from ..operators import bars as B
from ..operators.quality import Plan
from ..session import staged
from .tables import driver_table, literal_rows, spread

c = F.col

# Small dimensions of the synthetic market; the oracle repeats them as VALUES.
HOLIDAYS = ("2024-01-01", "2024-01-15")
UNIVERSE = (
    ("CLICK", "XNYS", date(2020, 1, 1), None), ("VIEW", "XNYS", date(2020, 1, 1), None),
    ("PURCHASE", "XNYS", date(2024, 1, 5), None), ("SIGNUP", "XNYS", date(2020, 1, 1), date(2024, 1, 25)),
    ("REFUND", "XNYS", date(2024, 1, 20), None),
)
ACTIONS = (
    ("s1", "CLICK", "split", date(2024, 1, 9), 2, None, None, 1),
    ("s2", "CLICK", "split", date(2024, 1, 22), 4, None, None, 1),
    ("s3", "ERROR", "split", date(2024, 1, 10), 2, None, None, 1),
    ("s4", "PURCHASE", "split", date(2024, 1, 20), 2, None, None, 1),
    ("s5", "VIEW", "split", date(2024, 1, 16), 2, None, None, 40),
    ("d1", "VIEW", "cash_dividend", date(2024, 1, 11), None, "0.5", date(2024, 1, 19), 1),
    ("d2", "CLICK", "cash_dividend", date(2024, 1, 18), None, "1.25", date(2024, 2, 2), 1),
)
PLAN = Plan(
    origin="historical", provider="events", feed="main", coverage_start=date(2024, 1, 2), coverage_end=date(2024, 1, 30),
    first_execution_session=date(2024, 1, 4), warmup_sessions=3, retrieved_at=datetime(2024, 1, 28),
    revision_policy="unknown", corporate_actions_coverage="unknown", limitations=("unknown_revision_timing",),
)
PART_SPLITS = (("P0", date(1997, 6, 2), 2), ("P0", date(1999, 3, 1), 4), ("P1", date(1998, 5, 4), 2))
PART_DIVIDENDS = (
    ("P0", "d1", date(1997, 6, 2), "0.5", date(1997, 6, 20)), ("P2", "d2", date(1998, 2, 2), "1.25", date(1998, 3, 1)),
    ("P1", "d3", date(1999, 1, 4), "0.1", date(2030, 1, 1)),
)


def ticks(spark: SparkSession, sf: str) -> DataFrame:
    events = driver_table(spark, sf, "events")
    return events.select(
        F.upper("event_type").alias("symbol"), c("ts").cast("timestamp").alias("t"),
        c("value").cast("decimal(24,8)").alias("price"),
        F.get_json_object("props", "$.k").cast("bigint").alias("volume"), c("event_id").alias("id"), "user_id",
        (c("ts").cast("timestamp") + F.expr("INTERVAL 1 HOUR")).alias("received_at"),
    )


def _weekdays(table: DataFrame, day: Column) -> DataFrame:
    """Weekdays of a column's range. Two dates reach the driver, so the calendar itself needs no further scan."""
    bounds = table.agg(F.min(day).alias("lo"), F.max(day).alias("hi")).first()
    span = F.sequence(F.lit(bounds["lo"]), F.lit(bounds["hi"]))
    days = table.sparkSession.range(1).select(F.explode(span).alias("session"))
    return days.where(F.dayofweek("session").between(2, 6))


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Weekdays of the events' range without two holidays; Fridays close early."""
    days = _weekdays(driver_table(spark, sf, "events"), F.to_date("ts"))
    at = c("session").cast("timestamp")
    return days.where(~c("session").cast("string").isin(*HOLIDAYS)).select(
        "session", (at + F.expr("INTERVAL '14:30' HOUR TO MINUTE")).alias("market_open"),
        (at + F.when(F.dayofweek("session") == 6, F.expr("INTERVAL 18 HOURS")).otherwise(F.expr("INTERVAL 21 HOURS")))
        .alias("market_close"),
    )


def opening_minutes(spark: SparkSession, sf: str) -> DataFrame:
    """Very short sessions: the first one or two minutes of each exchange date's CLICK ticks."""
    clicks = ticks(spark, sf).where(c("symbol") == "CLICK").withColumn("session", exchange_date(c("t")))
    opened = clicks.groupBy("session").agg(F.date_trunc("MINUTE", F.min("t")).alias("market_open"))
    length = F.make_dt_interval(F.lit(0), F.lit(0), 1 + F.dayofmonth("session") % 2)
    return opened.select("session", "market_open", (c("market_open") + length).alias("market_close"))


def order_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Weekdays of the order dates' range."""
    days = _weekdays(driver_table(spark, sf, "orders"), F.to_date("o_orderdate"))
    at = c("session").cast("timestamp")
    return days.select(
        "session", (at + F.expr("INTERVAL '14:30' HOUR TO MINUTE")).alias("market_open"),
        (at + F.expr("INTERVAL 21 HOURS")).alias("market_close"),
    )


def universe(spark: SparkSession) -> DataFrame:
    return literal_rows(spark, UNIVERSE, "symbol string, exchange string, listed_on date, delisted_on date")


def actions(spark: SparkSession) -> DataFrame:
    raw = literal_rows(
        spark, ACTIONS, "action_id string, symbol string, kind string, effective_session date, split_ratio int, "
        "amount string, pay_date date, delay int",
    )
    opened = c("effective_session").cast("timestamp") + F.expr("INTERVAL '14:30' HOUR TO MINUTE")
    return raw.select(
        "action_id", "symbol", "kind", "effective_session", opened.alias("available_at"),
        (opened + F.make_dt_interval(c("delay"))).alias("first_ingested_at"), c("split_ratio").cast("bigint").alias("split_ratio"),
        c("amount").cast("decimal(24,8)").alias("cash_amount_usd"), "pay_date",
    )


def market_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Bars of the regular sessions."""
    return B.daily_bars(ticks(spark, sf).where(c("price") > 0), sessions(spark, sf))


def declared_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Bars of every calendar date with a fixed declared interval: weekends, early closes and a second feed are in."""
    days = ticks(spark, sf).where(c("price") > 0).withColumn("session", exchange_date(c("t")))
    rolled = B.roll_up(days, ["symbol", "session"], extra=[F.max("received_at").alias("first_ingested_at")])
    at = c("session").cast("timestamp")
    return rolled.select(
        "symbol", "session", "open", "high", "low", "close", "volume", "first_ingested_at",
        (at + F.expr("INTERVAL '14:30' HOUR TO MINUTE")).alias("interval_start"),
        (at + F.expr("INTERVAL 21 HOURS")).alias("interval_end"),
        (at + F.expr("INTERVAL '21:15' HOUR TO MINUTE")).alias("available_at"),
        F.lit("historical").alias("origin"), F.lit("events").alias("provider"),
        F.when((c("symbol") == "VIEW") & (F.dayofmonth("session") % 10 == 3), "alt").otherwise("main").alias("feed"),
    )


def minute_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Captured pages, one per exchange date and symbol (at most a day of minutes each), with four kinds of faults."""
    minutes = B.minute_bars(ticks(spark, sf)).withColumn("day", exchange_date(c("t")))
    minute = F.minute("t")
    number = lambda name: number_text(c(name))
    row = F.concat(
        F.lit('{"t":"'), F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('","o":'), number("open"), F.lit(',"h":'),
        F.when(minute == 13, "0.001").otherwise(number("high")), F.lit(',"l":'), number("low"),
        F.when(minute == 11, "").otherwise(F.concat(F.lit(',"c":'), number("close"))), F.lit(',"v":'),
        c("volume").cast("string"), F.when(minute == 7, ".5").otherwise(""), F.lit(',"n":1}'),
    )
    rows = minutes.withColumn("row", F.when(minute == 17, F.concat(row, F.lit(","), row)).otherwise(row))
    pages = rows.groupBy("day", "symbol").agg(
        F.expr("listagg(row, ',') WITHIN GROUP (ORDER BY t)").alias("rows"), F.max("received_at").alias("received_at")
    )
    position = F.datediff("day", F.lit("2023-01-01").cast("date")) * 100 + F.ascii("symbol")
    return pages.select(
        F.lit("capture").alias("capture_id"), position.cast("bigint").alias("seq"), F.lit("/v2/stocks/bars").alias("path"),
        F.create_map(F.lit("start"), F.concat(c("day").cast("string"), F.lit("T14:30:00Z"))).alias("params"), "received_at",
        F.concat(F.lit('{"bars":{"'), c("symbol"), F.lit('":['), c("rows"), F.lit(']},"next_page_token":null}')).alias("body"),
    )


def action_pages(spark: SparkSession, sf: str) -> DataFrame:
    """One page with one corporate action per order, faults derived from the order key."""
    orders = spread(driver_table(spark, sf, "orders"))
    key = c("o_orderkey")
    text = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f',"{name}":"'), value, F.lit('"'))).otherwise("")
    bare = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f',"{name}":'), value)).otherwise("")
    day = F.to_date("o_orderdate")
    kind = F.when(key % 7 < 3, "forward_splits").when(key % 7 < 6, "cash_dividends").otherwise("spin_offs")
    body = F.concat(
        F.lit('{"corporate_actions":{"'), kind, F.lit('":[{"id":"'),
        F.when(key % 50 == 1, key - 1).otherwise(key).cast("string"), F.lit('"'),
        text("symbol", F.concat(F.lit("C"), (c("o_custkey") % 40).cast("string"))),
        text("ex_date", F.when(key % 31 != 0, day.cast("string"))),
        text("process_date", F.date_add(day, (key % 9 - 4).cast("int")).cast("string")),
        text("payable_date", F.date_add(day, 10).cast("string")),
        bare("old_rate", (1 + key % 2).cast("string")), bare("new_rate", (1 + key % 5).cast("string")),
        bare("rate", number_text(c("o_totalprice").cast("decimal(24,8)"))),
        bare("special", F.when(key % 13 == 0, "true").otherwise("false")),
        bare("foreign", F.when(key % 17 != 0, "false")),
        text("due_bill_redemption_date", F.when(key % 41 == 0, day.cast("string"))),
        F.lit('}]},"next_page_token":null}'),
    )
    return orders.select(
        F.lit("capture").alias("capture_id"), key.alias("seq"), F.lit("/v1/corporate-actions").alias("path"),
        c("o_orderdate").cast("timestamp").alias("received_at"), body.alias("body"),
    )


def fills(spark: SparkSession, sf: str) -> DataFrame:
    """Executions: line items with the clock and status of their order."""
    lines = driver_table(spark, sf, "lineitem")
    orders = driver_table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    return lines.join(orders, c("l_orderkey") == c("o_orderkey"))


def ledger_fills(spark: SparkSession, sf: str) -> DataFrame:
    quantity = c("l_quantity").cast("bigint")
    return driver_table(spark, sf, "lineitem").select(
        c("l_suppkey").alias("account"), F.concat(F.lit("P"), (c("l_partkey") % 5).cast("string")).alias("symbol"),
        F.to_date("l_shipdate").alias("session"),
        ((c("l_orderkey") * 8 + c("l_linenumber")) * 1_000_000 + c("l_partkey")).alias("seq"),
        F.when(c("l_returnflag") == "R", -quantity).otherwise(quantity).alias("quantity"),
        c("l_extendedprice").cast("decimal(18,2)").alias("price"), F.lit(1).cast("decimal(18,2)").alias("commission"),
    )


def supplier_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Bars of many symbols: the lowest and highest line item of a supplier and day as open and close."""
    day = F.to_date("l_shipdate")
    price = c("l_extendedprice").cast("decimal(24,8)")
    return driver_table(spark, sf, "lineitem").groupBy(
        F.concat(F.lit("S"), c("l_suppkey").cast("string")).alias("symbol"), day.alias("session")
    ).agg(F.min(price).alias("open"), F.max(price).alias("close")).withColumn(
        "available_at", c("session").cast("timestamp") + F.expr("INTERVAL 21 HOURS"))


def account_equity(spark: SparkSession, sf: str) -> DataFrame:
    """Value of each supplier's account per day it traded: a million and what its line items brought and took."""
    price = c("l_extendedprice").cast("decimal(18,2)")
    moved = driver_table(spark, sf, "lineitem").groupBy(c("l_suppkey").alias("account"), F.to_date("l_shipdate").alias("session")).agg(
        F.sum(F.when(c("l_linenumber") % 2 == 0, -price).otherwise(price)).alias("moved"))
    total = running(staged(moved, "account-moves"), ["account"], ["session"], {"equity": Scan("sum", c("moved"))}, F.date_trunc("YEAR", "session"))
    return total.select("account", "session", (c("equity") + 1_000_000).cast("decimal(20,2)").alias("equity"))


def part_marks(spark: SparkSession, sf: str) -> DataFrame:
    lines = driver_table(spark, sf, "lineitem")
    return lines.groupBy(
        F.concat(F.lit("P"), (c("l_partkey") % 5).cast("string")).alias("symbol"), F.to_date("l_shipdate").alias("session")
    ).agg(F.max(c("l_extendedprice").cast("decimal(18,2)")).alias("mark"))


def part_splits(spark: SparkSession) -> DataFrame:
    return literal_rows(spark, PART_SPLITS, "symbol string, effective_session date, split_ratio bigint")


def part_dividends(spark: SparkSession) -> DataFrame:
    raw = literal_rows(spark, PART_DIVIDENDS, "symbol string, action_id string, ex_session date, amount string, pay_date date")
    return raw.withColumn("amount", c("amount").cast("decimal(18,2)"))


def ship_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Weekdays of the ship dates' range."""
    days = _weekdays(driver_table(spark, sf, "lineitem"), F.to_date("l_shipdate"))
    at = c("session").cast("timestamp")
    return days.select("session", at.alias("market_open"), (at + F.expr("INTERVAL 1 DAY")).alias("market_close"))


def documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread(driver_table(spark, sf, "documents"))
    published = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval((c("doc_id") % 28).cast("int"))
    hours = F.make_dt_interval(F.lit(0), F.when(c("doc_id") % 50 == 0, -1).otherwise(c("doc_id") % 5).cast("int"))
    return docs.select(
        c("doc_id").alias("document_id"), c("text").alias("original_text"), sha256(c("text")).alias("content_sha256"),
        "n_chars", "lang", "source", published.alias("published_at"), (published + hours).alias("available_at"),
        (published + F.expr("INTERVAL 3 HOURS")).alias("first_ingested_at"),
    )


def evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Quotations of labelled documents from their first third to their last quarter, some of them broken."""
    labels = driver_table(spark, sf, "labels")
    docs = documents(spark, sf).select("document_id", "original_text", "content_sha256", "n_chars")
    joined = labels.join(docs, c("doc_id") == c("document_id"))
    start = F.floor(c("n_chars") / 3).cast("int")
    end = (c("n_chars") - F.floor(c("n_chars") / 4)).cast("int")
    piece = F.substring("original_text", start + 1, end - start)
    text = (
        F.when(c("toxic") == 1, F.concat(piece, F.lit("x")))
        .when(c("doc_id") % 6 == 1, F.concat(F.lit("#"), F.substring(piece, F.lit(2), F.length(piece))))
        .otherwise(piece)
    )
    return joined.select(
        F.when(c("doc_id") % 40 == 0, c("doc_id") + 1_000_000_000_000).otherwise(c("doc_id")).alias("document_id"),
        c("doc_id").alias("cited_by"),
        F.when((c("quality") == 0) & (c("doc_id") % 3 == 0), "bad").otherwise(c("content_sha256")).alias("content_sha256"),
        start.alias("start"), end.alias("end"), text.alias("text"),
    )


# Event types as job states.
JOB_STATES = {"signup": "queued", "click": "running", "purchase": "succeeded", "error": "failed", "view": "cancelled"}


def job_state(event_type: Column) -> Column:
    state = F.lit(None).cast("string")
    for kind, name in JOB_STATES.items():
        state = F.when(event_type == kind, name).otherwise(state)
    return state


def job_events(spark: SparkSession, sf: str) -> DataFrame:
    events = driver_table(spark, sf, "events")
    return events.select(
        c("user_id").alias("request_id"), c("event_id").alias("sequence"), c("ts").cast("timestamp").alias("at"),
        job_state(c("event_type")).alias("state"),
    )


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    """One job per event, for reports over job rows."""
    events = driver_table(spark, sf, "events")
    return events.select(
        c("event_id").alias("request_id"), c("ts").cast("timestamp").alias("created_at"),
        job_state(c("event_type")).alias("state"),
        (F.get_json_object("props", "$.k").cast("int") % 2 == 0).alias("cancellation_requested"),
    )


def order_books(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """All orders as two books of executions: finished ones as the local ledger, the rest as the broker's statement."""
    orders = driver_table(spark, sf, "orders")
    native = F.when(c("o_orderpriority") != "4-NOT SPECIFIED", F.concat_ws("/", c("o_custkey").cast("string"), F.date_format("o_orderdate", "yyyy-MM")))
    records = orders.select(
        c("o_orderkey").alias("record_id"), native.alias("native_id"), c("o_orderpriority").alias("symbol"), F.lit("buy").alias("side"),
        F.floor(c("o_totalprice") / 5000).cast("bigint").alias("quantity"), c("o_orderdate").cast("timestamp").alias("at"),
        c("o_totalprice").cast("decimal(24,8)").alias("price"), (c("o_orderstatus") == "F").alias("finished"),
    )
    return tuple(records.where(F.coalesce(c("finished"), F.lit(False)) == side).drop("finished") for side in (True, False))


def capture_contents(spark: SparkSession, sf: str) -> DataFrame:
    """One capture file per order as (path, content), faults derived from the order key."""
    orders = spread(driver_table(spark, sf, "orders"))
    fault = c("o_orderkey") % 11
    day = lambda n: F.date_add(F.to_date("o_orderdate"), n).cast("string")
    faulty = lambda n, wrong, right: F.when(fault == n, wrong).otherwise(right)
    at = lambda minute: F.concat(day(40), F.lit(f"T10:{minute:02d}:00Z"))
    page = F.concat(
        F.lit('{"body":"{\\"bars\\":{},\\"next_page_token\\":null}","params":{"limit":'), c("o_custkey").cast("string"),
        F.lit(',"start":"'), day(0), F.lit('"},"path":"/v2/stocks/bars","received_at":"'), faulty(5, at(9), at(2)),
        F.lit('","request_id":"'), c("o_orderpriority"), F.lit('","schema_version":1}'))
    request = F.concat(
        F.lit('{"adjustment":"raw","aggregation":"regular_session_from_1min","end_session":"'), faulty(6, day(-1), day(30)), F.lit('","feed":"'),
        faulty(4, F.lit("otc"), F.lit("sip")), F.lit('","first_execution_session":"'), day(5), F.lit('","interval":"1d","schema_version":1,"start_session":"'),
        day(0), F.lit('","universe":[{"exchange":"ARCA","listed_on":"1980-01-02","symbol":"'), faulty(9, F.lit("c"), F.lit("C")), c("o_custkey").cast("string"),
        F.lit('"}],"warmup_sessions":'), faulty(8, F.lit('"3"'), F.lit("3")), F.lit(',"zero_volume_policy":"reject"}'))
    text = F.concat(
        F.lit('{"adapter_version":"minutes.v1","captured_at":"'), at(5), F.lit('","origin":"'), faulty(3, F.lit("prospective"), F.lit("historical")),
        F.lit('","pages":['), page, faulty(10, F.concat(F.lit(","), page), F.lit("")), F.lit('],"request":'), request, F.lit(',"requested_at":"'), at(0),
        F.lit('","schema_version":1}'))
    stored = orders.select("o_orderkey", fault.alias("fault"), text.alias("text")).withColumn(
        "stored", F.when(c("fault") == 2, F.concat(F.lit(" "), "text")).when(c("fault") == 7, F.substring("text", 1, 100)).otherwise(c("text")))
    return stored.select(
        F.concat(F.lit("orders/"), c("o_orderkey").cast("string"), F.lit("/"), F.sha2("stored", 256), F.lit(".json")).alias("path"),
        F.when(c("fault") == 1, F.concat("stored", F.lit(" "))).otherwise(c("stored")).cast("binary").alias("content"))

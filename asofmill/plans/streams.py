"""Streaming twins run to completion on the driver's files; the oracle is the batch statement."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import adapters as A
from ..sources.tables import driver_table
from ..streaming import order_state as K
from ..streaming import twins as S
from .jobs import JOB_EVENTS
from .market import TICKS, text_of
from .registry import query

c = F.col


def _stream(spark, sf, name):
    # Written as a glob, because a file source takes a folder or a glob but not the name of one file.
    path = f"{sf.rstrip('/')}/{name}.[p]arquet"
    return S.file_stream(spark, path, driver_table(spark, sf, name).schema)


# The border is a millisecond clock fifteen minutes behind the newest tick; younger windows are still open.
@query(f"""WITH {TICKS}
SELECT symbol, {text_of("CAST(date_trunc('hour', t) AS TIMESTAMP)")} AS bucket, CAST(arg_min(price, (t, id)) AS DOUBLE) AS open,
  CAST(max(price) AS DOUBLE) AS high, CAST(min(price) AS DOUBLE) AS low, CAST(arg_max(price, (t, id)) AS DOUBLE) AS close,
  CAST(sum(volume) AS BIGINT) AS volume
FROM ticks WHERE date_trunc('hour', t) + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 15 MINUTE FROM events)
GROUP BY symbol, date_trunc('hour', t)""")
def stream_hourly_bars(spark, sf):
    events = _stream(spark, sf, "events")
    ticks = events.select(
        F.upper("event_type").alias("symbol"), c("ts").cast("timestamp").alias("t"),
        c("value").cast("decimal(24,8)").alias("price"), F.get_json_object("props", "$.k").cast("bigint").alias("volume"),
        c("event_id").alias("id"),
    )
    return S.merged_bars(ticks, "1 hour").drop("late_rows")


@query("SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem")
def stream_deduplicated_events(spark, sf):
    lines = _stream(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", c("l_shipdate").cast("timestamp").alias("at"))
    return S.merged_first_deliveries(lines, ["l_orderkey", "l_linenumber"]).drop("at")


@query("""SELECT l_orderkey AS order_id, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS filled_quantity,
  CAST(100 AS BIGINT) AS requested_quantity, sum(CAST(l_quantity AS BIGINT)) > 100 AS overfilled,
  count(*) FILTER (WHERE l_shipdate < o_orderdate) AS clock_violations
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey""")
def stream_fill_state(spark, sf):
    orders = driver_table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    events = _stream(spark, sf, "lineitem").join(orders, c("l_orderkey") == c("o_orderkey")).select(
        c("l_orderkey").alias("order_id"), c("l_quantity").cast("bigint").alias("fill_quantity_delta"),
        F.lit(100).cast("bigint").alias("requested_quantity"), c("l_shipdate").alias("recorded_at"), c("o_orderdate").alias("occurred_at"),
    )
    return S.merged_fills(events)


# Line items are executions of their order; every seventh is recorded before it occurred. Of repeated ids the last recorded counts.
@query(f"""WITH e AS (
  SELECT l_orderkey AS order_id, CAST(l_linenumber AS BIGINT) AS event_id, o_orderdate AS occurred_at,
    CASE WHEN l_partkey % 7 = 0 THEN o_orderdate - INTERVAL 1 HOUR ELSE l_shipdate END AS recorded_at,
    CAST(l_quantity AS BIGINT) AS delta, CAST(60 + l_orderkey % 90 AS BIGINT) AS requested
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
v AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY order_id, event_id ORDER BY recorded_at DESC, delta DESC) = 1),
r AS (SELECT *, CAST(sum(delta) OVER (PARTITION BY order_id ORDER BY event_id) AS BIGINT) AS running FROM v)
SELECT order_id, event_id, {text_of('occurred_at')} AS occurred_at, {text_of('recorded_at')} AS recorded_at, delta AS fill_quantity_delta,
  requested AS requested_quantity, running AS running_filled,
  CASE WHEN recorded_at < occurred_at THEN 'recorded_before_occurred' WHEN running > requested THEN 'overfilled' END AS illegal
FROM r""")
def stream_fill_events(spark, sf):
    orders = driver_table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    placed = c("o_orderdate").cast("timestamp")
    events = _stream(spark, sf, "lineitem").join(orders, c("l_orderkey") == c("o_orderkey")).select(
        c("l_orderkey").alias("order_id"), c("l_linenumber").alias("event_id"), placed.alias("occurred_at"),
        F.when(c("l_partkey") % 7 == 0, placed - F.expr("INTERVAL 1 HOUR")).otherwise(c("l_shipdate").cast("timestamp")).alias("recorded_at"),
        c("l_quantity").cast("bigint").alias("fill_quantity_delta"), (60 + c("l_orderkey") % 90).alias("requested_quantity"),
    )
    return K.judged_events(events)


@query(f"""WITH {JOB_EVENTS} SELECT request_id, arg_max(state, sequence) AS state, count(*) AS events FROM job_events GROUP BY request_id""")
def stream_job_states(spark, sf):
    events = _stream(spark, sf, "events").select(
        c("user_id").alias("request_id"), c("event_id").alias("sequence"), A.job_state(c("event_type")).alias("state")
    )
    return S.merged_lifecycles(events)

"""Fills, exposure, targets, ledger replay and scoring over orders and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ordered import running_sums
from ..functions.rules import first_reason
from ..operators import fills as X
from ..operators import ledger as L
from ..operators import portfolio as P
from ..operators import scoring as S
from ..operators.versions import rows_differ
from ..sources import adapters as A
from ..sources.tables import driver_table
from .registry import query

c = F.col

FILL_ORDER = [
    "l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus",
]
ORDER_SQL = ", ".join(FILL_ORDER)
LINES = "lines AS (SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


# ---- fills -----------------------------------------------------------------------------------------------------
def _running(spark, sf):
    return X.running_fills(
        driver_table(spark, sf, "lineitem"), "l_orderkey", c("l_quantity").cast("bigint"), [c(n) for n in FILL_ORDER],
        F.trunc(F.to_date("l_shipdate"), "MM"),
    )


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S.%fZ') AS recorded_at,
  CAST(l_quantity AS BIGINT) AS quantity, CAST(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY {ORDER_SQL}
  ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_filled
FROM lineitem""")
def fill_running_totals(spark, sf):
    return _running(spark, sf).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", c("l_shipdate").alias("recorded_at"),
        c("l_quantity").cast("bigint").alias("quantity"), "running_filled",
    )


@query(f"""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS BIGINT) AS q, 60 + l_orderkey % 90 AS requested,
  CAST(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY {ORDER_SQL} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running
  FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, running AS running_filled,
  CASE WHEN running > requested THEN 'overfilled' ELSE 'cumulative_mismatch' END AS mismatch
FROM r WHERE running > requested OR running <> q * l_linenumber""")
def overfilled_orders(spark, sf):
    running = _running(spark, sf).withColumn("requested_quantity", 60 + c("l_orderkey") % 90).withColumn(
        "cumulative_filled_quantity", c("l_quantity").cast("bigint") * c("l_linenumber")
    )
    return X.fill_mismatches(running).select("l_orderkey", "l_linenumber", "l_partkey", "running_filled", "mismatch")


@query("""WITH g AS (SELECT l_orderkey AS order_id, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS filled_quantity,
  100 AS requested_quantity, count(*) FILTER (WHERE l_quantity > 0) AS fills,
  count(*) FILTER (WHERE l_shipdate < o_orderdate) AS clock_violations
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey)
SELECT order_id, filled_quantity, CAST(requested_quantity AS BIGINT) AS requested_quantity, fills, clock_violations,
  CAST(greatest(requested_quantity - filled_quantity, 0) AS BIGINT) AS open_quantity,
  CASE WHEN filled_quantity > 100 THEN 'overfilled' WHEN filled_quantity = 100 THEN 'filled'
       WHEN filled_quantity > 0 THEN 'partial_fill' ELSE 'acknowledged' END AS status FROM g""")
def order_fill_status(spark, sf):
    events = A.fills(spark, sf).select(
        c("l_orderkey").alias("order_id"), c("l_quantity").cast("bigint").alias("fill_quantity_delta"),
        F.lit(100).cast("bigint").alias("requested_quantity"), c("l_shipdate").alias("recorded_at"),
        c("o_orderdate").alias("occurred_at"),
    )
    return X.order_status(events)


@query("""SELECT o_orderkey, count(*) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE l_shipdate < o_orderdate GROUP BY o_orderkey""")
def clock_violations(spark, sf):
    late = A.fills(spark, sf).where(c("l_shipdate") < c("o_orderdate"))
    return late.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("lines"))


EVENTS = """ev AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS BIGINT) AS delta,
    CAST(l_quantity AS BIGINT) + l_linenumber % 3 AS cumulative, 40 AS requested,
    CASE WHEN l_returnflag <> 'N' THEN l_extendedprice END AS price,
    CASE WHEN l_discount < 0.02 THEN 'acknowledged' WHEN l_linestatus = 'F' THEN 'filled' ELSE 'partial_fill' END AS status,
    CASE WHEN l_tax > 0.04 THEN 'broker' ELSE 'engine' END AS source,
    CASE o_orderstatus WHEN 'P' THEN 'paper' WHEN 'F' THEN 'backtest' ELSE 'shadow' END AS mode,
    CASE WHEN l_partkey % 10 <> 0 THEN l_partkey END AS engine_id, CASE WHEN l_suppkey % 10 <> 0 THEN l_suppkey END AS broker_id,
    l_shipdate AS recorded_at, o_orderdate AS occurred_at
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


@query(f"""WITH {EVENTS}
SELECT l_orderkey, l_linenumber, l_partkey, CASE
  WHEN recorded_at < occurred_at THEN 'recorded_before_occurred'
  WHEN NOT (delta <= cumulative AND cumulative <= requested) THEN 'quantity_order'
  WHEN status IN ('partial_fill', 'filled') AND (delta = 0 OR price IS NULL) THEN 'fill_without_execution'
  WHEN status = 'filled' AND cumulative <> requested THEN 'filled_short'
  WHEN status = 'partial_fill' AND cumulative >= requested THEN 'partial_without_rest'
  WHEN status = 'acknowledged' AND (delta <> 0 OR price IS NOT NULL) THEN 'execution_on_non_fill'
  WHEN source = 'broker' AND mode <> 'paper' THEN 'broker_outside_paper'
  WHEN source = 'engine' AND engine_id IS NULL THEN 'engine_order_missing'
  WHEN source = 'broker' AND broker_id IS NULL THEN 'broker_order_missing' END AS reason FROM ev""")
def execution_event_checks(spark, sf):
    quantity = c("l_quantity").cast("bigint")
    events = A.fills(spark, sf).select(
        "l_orderkey", "l_linenumber", "l_partkey", quantity.alias("fill_quantity_delta"),
        (quantity + c("l_linenumber") % 3).alias("cumulative_filled_quantity"), F.lit(40).cast("bigint").alias("requested_quantity"),
        F.when(c("l_returnflag") != "N", c("l_extendedprice").cast("decimal(24,8)")).alias("fill_price_usd"),
        F.when(c("l_discount") < 0.02, "acknowledged").when(c("l_linestatus") == "F", "filled").otherwise("partial_fill").alias("status"),
        F.when(c("l_tax") > 0.04, "broker").otherwise("engine").alias("source"),
        F.when(c("o_orderstatus") == "P", "paper").when(c("o_orderstatus") == "F", "backtest").otherwise("shadow").alias("mode"),
        F.when(c("l_partkey") % 10 != 0, c("l_partkey")).alias("engine_order_id"),
        F.when(c("l_suppkey") % 10 != 0, c("l_suppkey")).alias("broker_order_id"),
        c("l_shipdate").alias("recorded_at"), c("o_orderdate").alias("occurred_at"),
    )
    return events.select("l_orderkey", "l_linenumber", "l_partkey", first_reason(X.event_rules()).alias("reason"))


@query("""WITH t AS (SELECT *, CASE WHEN l_discount < 0.01 THEN 'cancelled' ELSE 'partial_fill' END AS status,
    (l_shipdate, l_linenumber * 1000000 + l_partkey) AS k FROM lineitem),
e AS (SELECT l_orderkey, min(k) AS fin FROM t WHERE status = 'cancelled' GROUP BY l_orderkey)
SELECT l_orderkey AS order_id, l_linenumber * 1000000 + l_partkey AS event_id FROM t JOIN e USING (l_orderkey) WHERE k > fin""")
def fills_after_terminal(spark, sf):
    events = driver_table(spark, sf, "lineitem").select(
        c("l_orderkey").alias("order_id"), c("l_shipdate").alias("occurred_at"),
        (c("l_linenumber") * F.lit(1_000_000).cast("bigint") + c("l_partkey")).alias("event_id"),
        F.when(c("l_discount") < 0.01, "cancelled").otherwise("partial_fill").alias("status"),
        c("l_quantity").cast("bigint").alias("fill_quantity_delta"),
    )
    return X.events_after_terminal(events).select("order_id", "event_id")


@query("""SELECT count(*) AS events FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)""")
def deduplicated_events(spark, sf):
    lines = driver_table(spark, sf, "lineitem").withColumn("event_id", c("l_orderkey") * 8 + c("l_linenumber"))
    return X.first_copies(lines.select("event_id")).agg(F.count(F.lit(1)).alias("events"))


@query("""SELECT o_orderkey, CASE WHEN NOT (o_orderpriority <> '1-URGENT' AND o_orderstatus <> 'P' AND o_orderkey % 10 <> 0)
  THEN 'unsupported_order' END AS reason FROM orders""")
def order_convention_guard(spark, sf):
    orders = driver_table(spark, sf, "orders")
    kind = F.when(c("o_orderpriority") == "1-URGENT", "limit").otherwise("market")
    force = F.when(c("o_orderstatus") == "P", "gtc").otherwise("day")
    return orders.select("o_orderkey", X.order_convention_fault(kind, force, c("o_orderkey") % 10 == 0).alias("reason"))


# ---- exposure --------------------------------------------------------------------------------------------------
HOLDINGS = """holdings AS (SELECT o_custkey AS portfolio, 'S' || CAST(l_partkey % 50 AS VARCHAR) AS symbol,
    CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity, max(CAST(l_extendedprice AS DECIMAL(18,2))) AS mark,
    max(l_shipdate) AS marked_at FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag <> 'R'
  GROUP BY o_custkey, l_partkey % 50),
pending AS (SELECT o_custkey AS portfolio, o_orderkey AS intention_id, 'S' || CAST(o_orderkey % 50 AS VARCHAR) AS symbol,
    CASE WHEN o_orderkey % 3 = 0 THEN 'sell' ELSE 'buy' END AS side, 1 + o_orderkey % 400 AS remaining,
    CASE WHEN o_orderkey % 3 <> 0 OR o_orderkey % 21 = 0 THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END AS reserved
  FROM orders WHERE o_orderstatus = 'O'),
cash AS (SELECT c_custkey AS portfolio, CAST(c_acctbal * 100 AS DECIMAL(18,2)) AS cash, CAST(c_nationkey AS DECIMAL(18,2)) AS receivable
  FROM customer)"""


def _holdings(spark, sf):
    kept = A.fills(spark, sf).where(c("l_returnflag") != "R")
    return kept.groupBy(
        c("o_custkey").alias("portfolio"), F.concat(F.lit("S"), (c("l_partkey") % 50).cast("string")).alias("symbol")
    ).agg(
        F.sum(c("l_quantity").cast("bigint")).alias("quantity"),
        F.max(c("l_extendedprice").cast("decimal(18,2)")).alias("raw_mark_usd"), F.max("l_shipdate").alias("marked_at"),
    )


def _pending(spark, sf):
    key = c("o_orderkey")
    zero = F.lit(0).cast("decimal(18,2)")
    return driver_table(spark, sf, "orders").where(c("o_orderstatus") == "O").select(
        c("o_custkey").alias("portfolio"), key.alias("intention_id"), F.concat(F.lit("S"), (key % 50).cast("string")).alias("symbol"),
        F.when(key % 3 == 0, "sell").otherwise("buy").alias("side"), (1 + key % 400).alias("remaining_quantity"),
        F.when((key % 3 != 0) | (key % 21 == 0), c("o_totalprice").cast("decimal(18,2)")).otherwise(zero).alias("reserved_cash_usd"),
    )


def _cash(spark, sf):
    return driver_table(spark, sf, "customer").select(
        c("c_custkey").alias("portfolio"), (c("c_acctbal") * 100).cast("decimal(18,2)").alias("cash_usd"),
        c("c_nationkey").cast("decimal(18,2)").alias("dividend_receivable_usd"),
        F.lit("2001-06-01").cast("timestamp_ntz").alias("as_of"),
    )


@query(f"""WITH {HOLDINGS}
SELECT portfolio, CAST(CAST(cash + receivable + coalesce((SELECT sum(quantity * mark) FROM holdings h
  WHERE h.portfolio = c.portfolio), 0) AS DECIMAL(18,2)) AS DOUBLE) AS equity_usd FROM cash c""")
def portfolio_equity(spark, sf):
    return P.equity(_cash(spark, sf), _holdings(spark, sf))


@query(f"""WITH {HOLDINGS}, r AS (SELECT portfolio, CAST(sum(reserved) AS DECIMAL(18,2)) AS reserved FROM pending GROUP BY portfolio)
SELECT c.portfolio, CAST(coalesce(reserved, 0) AS DOUBLE) AS reserved_cash_usd,
  CAST(CAST(cash - coalesce(reserved, 0) AS DECIMAL(18,2)) AS DOUBLE) AS spendable_cash_usd
FROM cash c LEFT JOIN r ON r.portfolio = c.portfolio""")
def spendable_cash(spark, sf):
    return P.spendable(_cash(spark, sf), _pending(spark, sf))


OVERSOLD = """oversold AS (SELECT s.portfolio, s.symbol, selling, coalesce(h.quantity, 0) AS held FROM
  (SELECT portfolio, symbol, CAST(sum(remaining) AS BIGINT) AS selling FROM pending WHERE side = 'sell' GROUP BY 1, 2) s
  LEFT JOIN holdings h ON h.portfolio = s.portfolio AND h.symbol = s.symbol WHERE selling > coalesce(h.quantity, 0))"""


@query(f"WITH {HOLDINGS}, {OVERSOLD} SELECT portfolio, symbol, selling, CAST(held AS BIGINT) AS held FROM oversold")
def oversold(spark, sf):
    return P.oversold(_pending(spark, sf), _holdings(spark, sf))


@query(f"""WITH {HOLDINGS}, {OVERSOLD}
SELECT DISTINCT portfolio, 'sell_reserves_cash' AS reason FROM pending WHERE side = 'sell' AND reserved <> 0
UNION ALL SELECT DISTINCT portfolio, 'mark_after_as_of' FROM holdings WHERE marked_at > TIMESTAMP '2001-06-01'
UNION ALL SELECT portfolio, 'reservations_exceed_cash' FROM cash c
  WHERE cash < (SELECT coalesce(sum(reserved), 0) FROM pending p WHERE p.portfolio = c.portfolio)
UNION ALL SELECT DISTINCT portfolio, 'sells_exceed_holding' FROM oversold""")
def portfolio_violations(spark, sf):
    return P.exposure_violations(_cash(spark, sf), _holdings(spark, sf), _pending(spark, sf))


@query(f"""WITH {HOLDINGS}
SELECT intention_id, portfolio, symbol FROM pending p
WHERE NOT EXISTS (SELECT 1 FROM holdings h WHERE h.portfolio = p.portfolio AND h.symbol = p.symbol)""")
def exposure_outside_universe(spark, sf):
    strangers = P.outside_universe(_pending(spark, sf), _holdings(spark, sf), ["portfolio", "symbol"])
    return strangers.select("intention_id", "portfolio", "symbol")


WEIGHTS = """w AS (SELECT l_orderkey, l_partkey, CAST(l_quantity AS BIGINT) AS percent FROM lineitem)"""


def _weights(spark, sf):
    return driver_table(spark, sf, "lineitem").select(
        c("l_orderkey").alias("context_id"), c("l_partkey").alias("symbol"),
        (c("l_quantity").cast("decimal(12,0)") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(24,8)").alias("weight"),
    )


@query(f"""WITH {WEIGHTS}, t AS (SELECT l_orderkey, CAST(sum(percent) AS BIGINT) AS p FROM w GROUP BY 1)
SELECT l_orderkey AS context_id, p / 100 AS total_weight, (100 - p) / 100 AS cash_weight,
  CASE WHEN p > 100 THEN 'total_above_one' END AS reason FROM t""")
def target_weight_check(spark, sf):
    return P.target_totals(_weights(spark, sf), ["context_id"])


@query(f"""WITH {WEIGHTS}, t AS (SELECT l_orderkey, CAST(sum(percent) AS BIGINT) AS p FROM w GROUP BY 1)
SELECT l_orderkey AS context_id, p / 100 AS total_weight FROM t WHERE NOT (p > 0 AND p <= 100)""")
def benchmark_weight_check(spark, sf):
    return P.benchmark_faults(_weights(spark, sf), ["context_id"])


@query(f"""WITH {WEIGHTS}, o AS (SELECT *, o_orderdate + INTERVAL 1 DAY AS x FROM orders), part5 AS (
  SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_partkey % 9 <> 0)
SELECT DISTINCT o_orderkey AS context_id, reason FROM (
  SELECT o_orderkey, unnest([
    CASE WHEN o_orderkey % 11 = 0 THEN 'clock_order' END,
    CASE WHEN o_orderkey % 7 = 0 THEN 'different_run' END,
    CASE WHEN o_orderpriority = '5-LOW' THEN 'different_strategy' END,
    CASE WHEN o_orderkey % 5 = 0 THEN 'different_clocks' END,
    CASE WHEN o_orderkey % 11 = 0 THEN 'feature_cutoff' END,
    CASE WHEN o_orderkey % 13 = 0 THEN 'expired_or_future' END]) AS reason FROM orders
  UNION ALL SELECT l_orderkey, 'total_above_one' FROM w GROUP BY l_orderkey HAVING sum(percent) > 100
  UNION ALL SELECT l_orderkey, 'outside_universe' FROM lineitem WHERE l_partkey % 9 = 0
  UNION ALL SELECT l_orderkey, 'duplicate_symbol' FROM lineitem GROUP BY l_orderkey, l_partkey HAVING count(*) > 1)
WHERE reason IS NOT NULL""")
def target_violations(spark, sf):
    key = c("o_orderkey")
    at = c("o_orderdate").cast("timestamp")
    days = lambda n: F.expr(f"INTERVAL {n} DAYS")
    orders = driver_table(spark, sf, "orders")
    contexts = orders.select(
        key.alias("context_id"), (key % 7).alias("run_id"), F.lit("e").alias("experiment_id"), F.lit("trend").alias("strategy_name"),
        F.lit("1").alias("strategy_version"), at.alias("decision_at"), (at + days(1)).alias("execution_at"),
        (at + days(3)).alias("target_expires_at"),
    )
    targets = orders.select(
        key.alias("context_id"), F.when(key % 7 == 0, F.lit(99)).otherwise(key % 7).alias("run_id"), F.lit("e").alias("experiment_id"),
        F.lit("trend").alias("strategy_name"), F.when(c("o_orderpriority") == "5-LOW", "2").otherwise("1").alias("strategy_version"),
        at.alias("decision_at"), F.when(key % 11 == 0, at + F.expr("INTERVAL 1 HOURS")).otherwise(at).alias("feature_cutoff"),
        (at + days(1)).alias("execution_at"), F.when(key % 5 == 0, at + days(2)).otherwise(at + days(3)).alias("expires_at"),
        F.when(key % 13 == 0, at + days(4)).alias("checked_at"),
    )
    weights = _weights(spark, sf)
    universe = driver_table(spark, sf, "lineitem").where(c("l_partkey") % 9 != 0).select(
        c("l_orderkey").alias("context_id"), c("l_partkey").alias("symbol")
    )
    return P.target_violations(targets, weights, contexts, universe)


# ---- ledger ----------------------------------------------------------------------------------------------------
def _later(day: str) -> str:
    return (f"CASE WHEN symbol = 'P0' AND {day} < DATE '1997-06-02' THEN 8 WHEN symbol = 'P0' AND {day} < DATE '1999-03-01' THEN 4 "
            f"WHEN symbol = 'P1' AND {day} < DATE '1998-05-04' THEN 2 ELSE 1 END")


LEDGER = f"""f AS (SELECT l_suppkey AS account, 'P' || CAST(l_partkey % 5 AS VARCHAR) AS symbol, CAST(l_shipdate AS DATE) AS session,
    (l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey AS seq,
    CASE WHEN l_returnflag = 'R' THEN -CAST(l_quantity AS BIGINT) ELSE CAST(l_quantity AS BIGINT) END AS quantity,
    CAST(l_extendedprice AS DECIMAL(18,2)) AS price FROM lineitem),
splits(symbol, day, ratio) AS (VALUES ('P0', DATE '1997-06-02', 2), ('P0', DATE '1999-03-01', 4), ('P1', DATE '1998-05-04', 2)),
dividends(symbol, action_id, ex, amount, pay) AS (VALUES ('P0', 'd1', DATE '1997-06-02', 0.50, DATE '1997-06-20'),
  ('P2', 'd2', DATE '1998-02-02', 1.25, DATE '1998-03-02'), ('P1', 'd3', DATE '1999-01-04', 0.10, CAST(NULL AS DATE))),
held AS (SELECT account, symbol, action_id, ex, pay,
    CAST(sum(quantity * ({_later('session')})) // max({_later('ex')}) AS BIGINT) AS shares, max(amount) AS amount
  FROM f JOIN dividends USING (symbol) WHERE session < ex GROUP BY account, symbol, action_id, ex, pay
  HAVING sum(quantity * ({_later('session')})) <> 0),
raw AS (
  SELECT account, symbol, session, 4 AS rank, seq, '' AS a, 'fill' AS event, quantity, -(quantity * price) - 1 AS cash, 0.00 AS recv FROM f
  UNION ALL SELECT account, symbol, ex, 1, 0, action_id, 'entitlement', 0, 0, shares * amount FROM held
  UNION ALL SELECT account, symbol, pay, 2, 0, action_id, 'payment', 0, shares * amount, -shares * amount FROM held WHERE pay IS NOT NULL
  UNION ALL SELECT account, s.symbol, s.day, 0, 0, '', 'split', 0, 0, 0
    FROM (SELECT account, symbol, min(session) AS first FROM f GROUP BY 1, 2) x JOIN splits s ON s.symbol = x.symbol AND s.day > x.first),
placed AS (SELECT *, CAST(sum(quantity * ({_later('session')})) OVER w // ({_later('session')}) AS BIGINT) AS position,
    10000 + sum(cash) OVER w AS cash_total, sum(recv) OVER w AS receivable
  FROM raw WINDOW w AS (PARTITION BY account, symbol ORDER BY session, rank, seq, a ROWS UNBOUNDED PRECEDING)),
marks AS (SELECT 'P' || CAST(l_partkey % 5 AS VARCHAR) AS symbol, CAST(l_shipdate AS DATE) AS session,
    max(CAST(l_extendedprice AS DECIMAL(18,2))) AS mark FROM lineitem GROUP BY 1, 2)"""


def _dividends(spark, sf):
    return L.payment_sessions(A.part_dividends(spark), A.ship_sessions(spark, sf))


@query(f"""WITH {LEDGER}
SELECT account, p.symbol, CAST(p.session AS VARCHAR) AS session, seq, event, quantity, position,
  CAST(CAST(cash_total AS DECIMAL(18,2)) AS DOUBLE) AS cash, CAST(CAST(receivable AS DECIMAL(18,2)) AS DOUBLE) AS receivable,
  CAST(mark AS DOUBLE) AS mark, CAST(CAST(cash_total + receivable + position * mark AS DECIMAL(18,2)) AS DOUBLE) AS equity
FROM placed p LEFT JOIN marks m ON m.symbol = p.symbol AND m.session = p.session WHERE event <> 'split' OR position <> 0""")
def ledger_replay(spark, sf):
    ledger = L.ledger_replay(
        A.ledger_fills(spark, sf), A.part_splits(spark), _dividends(spark, sf), A.part_marks(spark, sf), F.lit(10000),
    )
    return ledger.drop("rank")


@query(f"""WITH {LEDGER}
SELECT account, symbol, action_id, CAST(ex AS VARCHAR) AS ex_session, CAST(pay AS VARCHAR) AS pay_session, shares AS position,
  CAST(CAST(shares * amount AS DECIMAL(18,2)) AS DOUBLE) AS amount FROM held""")
def dividend_entitlements(spark, sf):
    return L.entitlements(A.ledger_fills(spark, sf), A.part_splits(spark), _dividends(spark, sf))


@query(f"""WITH {LEDGER}
SELECT account, CAST(CAST(sum(shares * amount) AS DECIMAL(18,2)) AS DOUBLE) AS receivable FROM held
WHERE ex <= DATE '1998-02-10' AND (pay IS NULL OR pay > DATE '1998-02-10') GROUP BY account""")
def unpaid_dividends(spark, sf):
    held = L.entitlements(A.ledger_fills(spark, sf), A.part_splits(spark), _dividends(spark, sf))
    return L.unpaid(held, F.lit("1998-02-10").cast("date"))


@query(f"""WITH {LEDGER}, b AS (
  SELECT account, symbol, session, seq, quantity, quantity * price AS cost FROM f WHERE quantity > 0
  UNION ALL SELECT account, s.symbol, s.day, -1, 0, 0
    FROM (SELECT account, symbol, min(session) AS first FROM f GROUP BY 1, 2) x JOIN splits s ON s.symbol = x.symbol AND s.day > x.first),
r AS (SELECT *, CAST(sum(quantity * ({_later('session')})) OVER w // ({_later('session')}) AS BIGINT) AS units, sum(cost) OVER w AS total
  FROM b WINDOW w AS (PARTITION BY account, symbol ORDER BY session, seq ROWS UNBOUNDED PRECEDING))
SELECT account, symbol, CAST(session AS VARCHAR) AS session, seq, quantity, units AS bought_quantity,
  CAST(CAST(total * 100 AS BIGINT) // units AS BIGINT) AS average_price_cents FROM r WHERE units > 0""")
def average_fill_price(spark, sf):
    prices = L.average_buy_price(A.ledger_fills(spark, sf), A.part_splits(spark))
    return prices.withColumn("average_price_cents", F.floor(c("average_price") * 100).cast("bigint")).drop("average_price")


@query("SELECT CAST(0 AS BIGINT) AS differing_rows FROM (SELECT count(*) FROM lineitem)")
def ledger_equality(spark, sf):
    """Two ways to total the same fills have to agree: sliced running sums against a grouped sum."""
    fills = A.ledger_fills(spark, sf)
    last = running_sums(
        fills, ["account"], [c("session"), c("seq")], {"held": c("quantity")}, F.trunc("session", "MM"), hot_rows=100
    ).groupBy("account").agg(F.max_by("held", F.struct("session", "seq")).alias("held"))
    total = fills.groupBy("account").agg(F.sum("quantity").alias("held"))
    return rows_differ(last, total).agg(F.count(F.lit(1)).alias("differing_rows"))


# ---- scoring ---------------------------------------------------------------------------------------------------
@query("""WITH p AS (SELECT avg(l_quantity) AS mx, avg(l_extendedprice) AS my,
  regr_slope(l_extendedprice, l_quantity) * count(*) / (count(*) + 1.0) AS w FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, round(my + w * (l_quantity - mx), 3) AS prediction FROM lineitem, p""")
def ridge_score(spark, sf):
    lines = driver_table(spark, sf, "lineitem")
    parameters = S.ridge_parameters(lines, "l_quantity", "l_extendedprice")
    prediction = S.ridge_score(lines, parameters, "l_quantity")
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", F.round(prediction, 3).alias("prediction"))


@query("""SELECT max(abs(l_extendedprice - l_quantity * 2000)) AS largest_error,
  max(abs(l_extendedprice - l_quantity * 2000)) <= 1e-12 AS within_tolerance FROM lineitem""")
def prediction_error(spark, sf):
    rows = driver_table(spark, sf, "lineitem").select(c("l_extendedprice").alias("expected"), (c("l_quantity") * 2000).alias("predicted"))
    return S.largest_error(rows, "expected", "predicted", 1e-12)

"""Rules, labels and results over time: signals, forward labels, drawdowns, halts, holding periods and cost scenarios."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import allocation as N
from ..operators import categories as K
from ..operators import controls as H
from ..operators import labels as Y
from ..operators import performance as P
from ..operators import reconciliation as R
from ..operators import signals as G
from ..sources import adapters as A
from ..sources.tables import driver_table
from .registry import query

c = F.col

BARS = """bars AS (
  SELECT 'S' || l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS session, min(CAST(l_extendedprice AS DECIMAL(24,8))) AS open,
         max(CAST(l_extendedprice AS DECIMAL(24,8))) AS close
  FROM lineitem GROUP BY l_suppkey, CAST(l_shipdate AS DATE))"""
EQUITY = """moved AS (
  SELECT l_suppkey AS account, CAST(l_shipdate AS DATE) AS session,
    sum(CAST(l_extendedprice AS DECIMAL(18,2)) * CASE WHEN l_linenumber % 2 = 0 THEN -1 ELSE 1 END) AS moved
  FROM lineitem GROUP BY l_suppkey, CAST(l_shipdate AS DATE)),
equity AS (SELECT account, session, 1000000 + sum(moved) OVER (PARTITION BY account ORDER BY session) AS equity FROM moved)"""


def _year():
    return F.date_trunc("YEAR", "session")


@query(f"""WITH {BARS}, r AS (
  SELECT *, CAST(close * 100000000 AS HUGEINT) * 1000000000 // CAST(lag(close) OVER (PARTITION BY symbol ORDER BY session) * 100000000 AS HUGEINT) - 1000000000 AS r FROM bars),
f AS (SELECT *, count(*) OVER last20 AS n, sum(close) OVER last5 AS fast, sum(close) OVER last20 AS slow,
    count(r) OVER last10 AS k, sum(r) OVER last10 AS s, sum(r * r) OVER last10 AS q
  FROM r WINDOW last5 AS (PARTITION BY symbol ORDER BY session ROWS 4 PRECEDING), last10 AS (PARTITION BY symbol ORDER BY session ROWS 9 PRECEDING),
    last20 AS (PARTITION BY symbol ORDER BY session ROWS 19 PRECEDING)),
j AS (SELECT symbol, session, CASE WHEN n < 20 THEN 'warmup' WHEN fast * 20 > slow * 5 THEN 'above' WHEN fast * 20 < slow * 5 THEN 'below' ELSE 'tie' END AS signal,
    CASE WHEN k = 10 THEN round(sqrt(CAST(k * q - s * s AS DOUBLE) / 90) / 1000000000, 9) END AS volatility FROM f),
w AS (SELECT *, count(*) FILTER (signal = 'above') OVER (PARTITION BY session) AS above FROM j)
SELECT symbol, CAST(session AS VARCHAR) AS session, signal, volatility,
  CASE WHEN signal <> 'above' THEN signal WHEN volatility IS NULL THEN 'undefined_volatility' WHEN volatility = 0 THEN 'zero_volatility'
    WHEN 0.2 / volatility > 0.5 THEN 'capped' ELSE 'scaled' END AS reason,
  CASE WHEN signal = 'above' AND volatility > 0 THEN round(least(0.5, 0.2 / volatility) / above, 9) ELSE 0 END AS weight
FROM w""")
def trend_targets(spark, sf):
    signals = G.trend_signals(A.supplier_bars(spark, sf), 5, 20, 10, _year())
    return G.trend_targets(signals, 0.2, 0.5).select("symbol", "session", "signal", "volatility", "reason", "weight")


LABELS = f"""{BARS}, range AS (SELECT min(session) AS lo, max(session) AS hi FROM bars),
places AS (SELECT CAST(d AS DATE) AS session, row_number() OVER (ORDER BY d) AS place
  FROM (SELECT unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS d FROM range) WHERE isodow(d) < 6),
placed AS (SELECT * FROM bars JOIN places USING (session)),
labels AS (SELECT h.symbol, h.session, e.session AS label_start, x.session AS label_end,
    CASE WHEN e.symbol IS NULL THEN 'no_entry' WHEN x.symbol IS NULL THEN 'no_exit' WHEN x.session >= DATE '1998-06-01' THEN 'immature' ELSE 'ready' END AS status,
    CAST(x.open AS DOUBLE) / CAST(e.open AS DOUBLE) - 1 AS forward_return
  FROM placed h LEFT JOIN placed e ON e.symbol = h.symbol AND e.place = h.place + 1 LEFT JOIN placed x ON x.symbol = h.symbol AND x.place = h.place + 6)"""
HELD = "(session BETWEEN DATE '1994-03-01' AND DATE '1994-03-31' OR session BETWEEN DATE '1996-09-01' AND DATE '1996-12-15')"


def _labels(spark, sf):
    return Y.forward_labels(A.supplier_bars(spark, sf), A.ship_sessions(spark, sf), 5, F.lit("1998-06-01").cast("timestamp"))


@query(f"""WITH {LABELS}
SELECT symbol, CAST(session AS VARCHAR) AS session, CAST(label_start AS VARCHAR) AS label_start, CAST(label_end AS VARCHAR) AS label_end, status,
  CASE WHEN status = 'ready' THEN forward_return END AS forward_return FROM labels""")
def forward_labels(spark, sf):
    return _labels(spark, sf)


@query(f"""WITH {LABELS}, ready AS (SELECT *, {HELD} AS held FROM labels WHERE status = 'ready'),
test AS (SELECT DISTINCT label_start, label_end FROM ready WHERE held)
SELECT symbol, CAST(session AS VARCHAR) AS session, CAST(label_start AS VARCHAR) AS label_start, CAST(label_end AS VARCHAR) AS label_end,
  CASE WHEN held THEN 'test' WHEN EXISTS (SELECT 1 FROM test t WHERE t.label_start <= r.label_end AND t.label_end >= r.label_start) THEN 'purged' ELSE 'train' END AS part
FROM ready r""")
def purged_split(spark, sf):
    held = c("session").between(F.lit("1994-03-01").cast("date"), F.lit("1994-03-31").cast("date")) | c("session").between(
        F.lit("1996-09-01").cast("date"), F.lit("1996-12-15").cast("date"))
    return Y.purged_split(_labels(spark, sf), held).select("symbol", "session", "label_start", "label_end", "part")


@query(f"""WITH {EQUITY}, p AS (
  SELECT *, max(equity) OVER (PARTITION BY account ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM equity),
n AS (SELECT *, sum(CASE WHEN before IS NULL OR equity >= before THEN 1 ELSE 0 END) OVER (PARTITION BY account ORDER BY session) AS episode FROM p),
g AS (SELECT account, episode, min(session) AS peak_session, max(equity) AS peak, min(equity) AS trough, arg_min(session, (equity, session)) AS trough_session,
    count(*) - 1 AS sessions_under FROM n GROUP BY account, episode),
l AS (SELECT *, lead(peak_session) OVER (PARTITION BY account ORDER BY episode) AS recovery_session FROM g)
SELECT account, CAST(peak_session AS VARCHAR) AS peak_session, CAST(peak AS DOUBLE) AS peak, CAST(trough_session AS VARCHAR) AS trough_session,
  CAST(trough AS DOUBLE) AS trough, CAST(recovery_session AS VARCHAR) AS recovery_session, sessions_under,
  (CAST(peak AS DOUBLE) - CAST(trough AS DOUBLE)) / nullif(CAST(peak AS DOUBLE), 0) AS drawdown
FROM l WHERE sessions_under > 0""")
def drawdowns(spark, sf):
    return P.drawdowns(A.account_equity(spark, sf), ["account"], _year())


# Accounts may be reset on the fifteenth of a month.
@query(f"""WITH {EQUITY}, resets AS (SELECT account, session FROM equity WHERE day(session) = 15),
marks AS (SELECT account, session, 0 AS kind, NULL AS equity FROM resets UNION ALL SELECT account, session, 1, equity FROM equity),
cut AS (SELECT *, count(*) FILTER (kind = 0) OVER (PARTITION BY account ORDER BY session, kind) AS part FROM marks),
based AS (SELECT *, lag(equity IGNORE NULLS) OVER seen AS prior, max(equity) OVER (PARTITION BY account, part ORDER BY session, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS peak
  FROM cut WINDOW seen AS (PARTITION BY account, part ORDER BY session, kind)),
judged AS (SELECT *, CASE WHEN kind = 0 THEN NULL WHEN prior > 0 AND CAST(prior - equity AS DOUBLE) >= 0.05 * CAST(prior AS DOUBLE) THEN 'daily_loss'
    WHEN peak > 0 AND CAST(peak - equity AS DOUBLE) >= 0.15 * CAST(peak AS DOUBLE) THEN 'drawdown' END AS reason FROM based),
events AS (SELECT account, session, kind, CASE WHEN kind = 0 THEN 'reset' WHEN reason IS NOT NULL THEN 'tripped' END AS event, reason FROM judged),
seen AS (SELECT *, lag(event) OVER (PARTITION BY account ORDER BY session, kind) AS was FROM events WHERE event IS NOT NULL)
SELECT account, CAST(session AS VARCHAR) AS session, event, reason FROM seen
WHERE (event = 'reset' AND was = 'tripped') OR (event = 'tripped' AND was IS DISTINCT FROM 'tripped')""")
def account_halts(spark, sf):
    equity = A.account_equity(spark, sf)
    resets = equity.where(F.dayofmonth("session") == 15).select("account", "session")
    return H.halts(equity, resets, ["account"], F.lit(0.05), F.lit(0.15), _year())


# Every unit is a row of its own here: the k-th bought leaves with the k-th sold.
@query("""WITH fills AS (SELECT l_suppkey AS account, 'P' || (l_partkey % 5) AS symbol, CAST(l_shipdate AS DATE) AS session,
    (l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey AS seq, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS side,
    CAST(l_quantity AS BIGINT) AS quantity, CAST(l_extendedprice AS DECIMAL(18,2)) AS price FROM lineitem),
units AS (SELECT account, symbol, side, session, row_number() OVER (PARTITION BY account, symbol, side ORDER BY session, seq) AS k
  FROM (SELECT account, symbol, side, session, seq, unnest(range(quantity)) AS unit FROM fills)),
closed AS (SELECT b.account, b.symbol, count(*) AS n, sum(datediff('day', b.session, s.session)) AS days
  FROM units b JOIN units s ON b.side = 1 AND s.side = -1 AND b.account = s.account AND b.symbol = s.symbol AND b.k = s.k GROUP BY 1, 2),
totals AS (SELECT account, symbol, count(*) AS trades, sum(quantity * side) AS open_quantity, sum(quantity * price) AS traded FROM fills GROUP BY 1, 2)
SELECT t.account, t.symbol, CAST(coalesce(n, 0) AS BIGINT) AS closed_quantity, CAST(open_quantity AS BIGINT) AS open_quantity, trades, CAST(traded AS DOUBLE) AS traded_value,
  CAST(days AS DOUBLE) / n AS mean_days_held
FROM totals t LEFT JOIN closed c ON c.account = t.account AND c.symbol = t.symbol""")
def holding_periods(spark, sf):
    return P.holding_periods(A.ledger_fills(spark, sf), ["account", "symbol"], ["session", "seq"], _year())


SCENARIOS = [P.Scenario(f"{bps}bps_{commission}_{delay}d", bps, str(commission), delay) for bps in (0, 5, 10, 25, 50) for commission in (0, 1) for delay in (0, 1)]
_SCENARIO_ROWS = ", ".join(f"('{s.name}', {s.bps}, {s.commission}, {s.delay})" for s in SCENARIOS)


@query(f"""WITH scenarios(scenario, bps, commission, delay) AS (VALUES {_SCENARIO_ROWS}),
fills AS (SELECT l_suppkey AS account, 'P' || (l_partkey % 5) AS symbol, datediff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) AS place,
    CAST(l_quantity AS BIGINT) * CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS q FROM lineitem),
prices AS (SELECT 'P' || (l_partkey % 5) AS symbol, datediff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) AS place,
    CAST(max(CAST(l_extendedprice AS DECIMAL(18,2))) * 100 AS BIGINT) AS cents FROM lineitem GROUP BY 1, 2)
SELECT account, f.symbol, scenario, count(*) AS fills, count(*) FILTER (p.cents IS NULL) AS unpriced,
  CAST(sum(-q * cents * 10000 - abs(q) * cents * bps - commission * 1000000) AS DOUBLE) / 1000000 AS cash
FROM fills f CROSS JOIN scenarios s LEFT JOIN prices p ON p.symbol = f.symbol AND p.place = f.place + s.delay GROUP BY account, f.symbol, scenario""")
def cost_scenarios(spark, sf):
    place = F.datediff("session", F.lit("1990-01-01").cast("date")).cast("bigint").alias("place")
    fills = A.ledger_fills(spark, sf).select("account", "symbol", place, "quantity")
    prices = A.part_marks(spark, sf).select("symbol", place, c("mark").alias("price"))
    return P.cost_sweep(fills, prices, ["account", "symbol"], SCENARIOS)


# Whole millionths of a dollar: cents times ten-thousandths.
@query("""WITH lines AS (SELECT l_suppkey AS account, 'P' || (l_partkey % 5) AS symbol, l_suppkey * 7 + (l_partkey % 5) * 13 AS k, max(CAST(l_extendedprice AS DECIMAL(18,2))) AS price,
    CAST(sum(l_quantity) AS BIGINT) % 7 AS held, count(*) % 3 - 1 AS pending FROM lineitem GROUP BY 1, 2, 3),
targets AS (SELECT account, symbol, k % 9 * 500 AS weight, CASE WHEN k % 11 <> 3 THEN CAST(price * 100 AS BIGINT) END AS cents, held, pending FROM lines),
accounts AS (SELECT s_suppkey AS account, 100000000 + CAST(CAST(s_acctbal AS DECIMAL(18,2)) * 100 AS BIGINT) AS equity FROM supplier WHERE s_suppkey % 19 <> 0),
sized AS (SELECT t.*, a.account AS known, CAST(equity // 4 AS HUGEINT) * 10000 AS cash, CAST(weight AS HUGEINT) * equity // (cents * 10000) - held - pending AS wanted
  FROM targets t LEFT JOIN accounts a USING (account)),
costed AS (SELECT *, least(abs(wanted), 300) AS most, cents * 10010 AS unit,
    CASE WHEN wanted > 0 THEN least(abs(wanted), 300) * cents * 10010 + 1000000 ELSE 0 END AS whole FROM sized),
paid AS (SELECT *, coalesce(sum(whole) OVER (PARTITION BY account ORDER BY whole DESC, symbol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM costed),
cut AS (SELECT *, CASE WHEN wanted > 0 THEN least(most, greatest(0, cash - before - 1000000) // unit) END AS bought FROM paid)
SELECT account, symbol, CAST(wanted AS BIGINT) AS wanted, CAST(CASE WHEN wanted > 0 THEN bought WHEN wanted < 0 THEN -most ELSE 0 END AS BIGINT) AS quantity,
  CAST(CASE WHEN bought > 0 THEN bought * unit + 1000000 ELSE 0 END AS DOUBLE) / 1000000 AS cost,
  CASE WHEN known IS NULL THEN 'no_account' WHEN cents IS NULL THEN 'invalid_price' WHEN wanted = 0 THEN 'covered' WHEN bought = 0 THEN 'no_cash'
    WHEN bought < most THEN 'cash' WHEN abs(wanted) > most THEN 'max_order' WHEN wanted < 0 THEN 'sell' ELSE 'buy' END AS reason
FROM cut""")
def share_deltas(spark, sf):
    k = c("l_suppkey") * 7 + c("l_partkey") % 5 * 13
    lines = driver_table(spark, sf, "lineitem").groupBy(c("l_suppkey").alias("account"), F.concat(F.lit("P"), (c("l_partkey") % 5).cast("string")).alias("symbol"), k.alias("k")).agg(
        F.max(c("l_extendedprice").cast("decimal(18,2)")).alias("price"), (F.sum("l_quantity").cast("bigint") % 7).alias("held"), (F.count(F.lit(1)) % 3 - 1).alias("pending"))
    targets = lines.select("account", "symbol", (c("k") % 9 * 500 / 10_000).cast("decimal(5,4)").alias("weight"), F.when(c("k") % 11 != 3, c("price")).alias("price"), "held", "pending")
    balance = (1_000_000 + c("s_acctbal").cast("decimal(18,2)")).cast("decimal(20,2)")
    accounts = driver_table(spark, sf, "supplier").where(c("s_suppkey") % 19 != 0).select(
        c("s_suppkey").alias("account"), balance.alias("equity"), (F.expr("(1000000 + CAST(s_acctbal AS DECIMAL(18,2))) * 100 DIV 4") / 100).cast("decimal(20,2)").alias("cash"))
    return N.share_deltas(targets, accounts, 10, F.lit(1).cast("decimal(10,2)"), F.lit(300), F.lit(0))


_EDGES = ", ".join(map(str, K.poisson_edges()))


@query(f"""WITH answers AS (SELECT d.doc_id, d.lang, d.source, CASE WHEN l.quality IS NULL THEN 'unknown' WHEN d.n_chars % 17 = 0 THEN 'invalid'
    WHEN d.n_chars % 3 = l.quality THEN 'correct' ELSE 'wrong' END AS outcome, l.toxic = 0 AS supported FROM documents d LEFT JOIN labels l USING (doc_id)),
sets AS (SELECT doc_id, outcome, supported, lang, source, 0 AS together FROM answers UNION ALL SELECT doc_id, outcome, supported, lang, NULL, 1 FROM answers
  UNION ALL SELECT doc_id, outcome, supported, NULL, source, 1 FROM answers UNION ALL SELECT doc_id, outcome, supported, NULL, NULL, 2 FROM answers),
places AS (SELECT doc_id, r, CAST('0x' || substr(md5(doc_id || '/' || r || '/1'), 1, 8) AS BIGINT) AS place FROM answers, range(40) x(r)),
weights AS (SELECT doc_id, r, len(list_filter([{_EDGES}], lambda e: place >= e)) AS w FROM places),
drawn AS (SELECT lang, source, together, r, sum(w) AS d, sum(w) FILTER (outcome = 'correct') AS c FROM sets JOIN weights USING (doc_id)
  WHERE outcome IN ('correct', 'wrong') GROUP BY lang, source, together, r),
spread AS (SELECT lang, source, together, list_sort(list(CAST(coalesce(c, 0) AS DOUBLE) / d)) AS a FROM drawn WHERE d > 0 GROUP BY lang, source, together),
counted AS (SELECT lang, source, together, count(*) AS answers, count(*) FILTER (outcome = 'correct') AS correct, count(*) FILTER (outcome = 'wrong') AS wrong,
    count(*) FILTER (outcome = 'unknown') AS "unknown", count(*) FILTER (outcome = 'invalid') AS invalid, count(*) FILTER (outcome IN ('correct', 'wrong') AND supported) AS supported
  FROM sets GROUP BY lang, source, together)
SELECT c.lang, c.source, CAST(c.together AS INTEGER) AS together, answers, correct, wrong, "unknown", invalid, supported,
  CAST(correct AS DOUBLE) / nullif(correct + wrong, 0) AS accuracy, CAST(supported AS DOUBLE) / nullif(correct + wrong, 0) AS support_rate,
  CAST("unknown" AS DOUBLE) / answers AS unknown_rate, CAST(invalid AS DOUBLE) / answers AS invalid_rate, a[len(a) // 40 + 1] AS low, a[len(a) - len(a) // 40] AS high
FROM counted c LEFT JOIN spread s ON s.lang IS NOT DISTINCT FROM c.lang AND s.source IS NOT DISTINCT FROM c.source AND s.together = c.together""")
def category_rates(spark, sf):
    labels = driver_table(spark, sf, "labels").select(c("doc_id").alias("labelled"), "quality", "toxic")
    docs = driver_table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    outcome = (
        F.when(c("quality").isNull(), "unknown").when(c("n_chars") % 17 == 0, "invalid").when(c("n_chars") % 3 == c("quality"), "correct").otherwise("wrong")
    )
    answers = docs.join(labels, c("doc_id") == c("labelled"), "left").select("doc_id", "lang", "source", outcome.alias("outcome"), (c("toxic") == 0).alias("supported"))
    return K.category_rates(answers, ["lang", "source"], "doc_id")


# One pair of a key and round is the closest of those left; the operator takes all that are nearest to each other at once.
@query("""WITH RECURSIVE records AS (
  SELECT o_orderkey AS id, CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_custkey || '/' || strftime(o_orderdate, '%Y-%m') END AS native,
    o_orderpriority AS symbol, CAST(floor(o_totalprice / 5000) AS BIGINT) AS quantity, o_orderdate AS at, CAST(o_totalprice AS DECIMAL(24,8)) AS price,
    coalesce(o_orderstatus = 'F', false) AS local FROM orders),
ranked AS (SELECT *, row_number() OVER (PARTITION BY local, native ORDER BY id) AS n FROM records WHERE native IS NOT NULL),
by_id AS (SELECT a.id AS l, b.id AS b FROM ranked a JOIN ranked b ON a.local AND NOT b.local AND a.native = b.native AND a.n = b.n),
rest AS (SELECT * FROM records WHERE id NOT IN (SELECT l FROM by_id UNION ALL SELECT b FROM by_id)),
greedy AS (
  SELECT a.symbol, a.quantity, a.id AS l, b.id AS b, abs(date_diff('microsecond', a.at, b.at)) AS gap, a.at AS lt, b.at AS bt, false AS chosen
  FROM rest a JOIN rest b ON a.local AND NOT b.local AND a.symbol = b.symbol AND a.quantity = b.quantity AND b.at BETWEEN a.at - INTERVAL 20 DAY AND a.at + INTERVAL 20 DAY
  UNION ALL
  SELECT symbol, quantity, l, b, gap, lt, bt, l = fl AND b = fb FROM (
    SELECT *, first_value(l) OVER w AS fl, first_value(b) OVER w AS fb FROM greedy WHERE NOT chosen
    WINDOW w AS (PARTITION BY symbol, quantity ORDER BY gap, lt, bt, l, b))
  WHERE (l = fl AND b = fb) OR (l <> fl AND b <> fb)),
pairs AS (SELECT l, b, 'native_id' AS matched_by FROM by_id UNION ALL SELECT l, b, 'nearest' FROM greedy WHERE chosen),
judged AS (SELECT l, b, matched_by, concat_ws(',', CASE WHEN x.symbol <> y.symbol THEN 'symbol' END, CASE WHEN x.quantity <> y.quantity THEN 'quantity' END,
    CASE WHEN abs(x.price - y.price) > 2000 THEN 'price' END, CASE WHEN abs(date_diff('microsecond', x.at, y.at)) > 1728000000000 THEN 'at' END) AS differences
  FROM pairs JOIN records x ON x.id = l JOIN records y ON y.id = b)
SELECT l AS local_id, b AS broker_id, CASE WHEN differences = '' THEN 'matched' ELSE 'differing' END AS status, matched_by, differences FROM judged
UNION ALL SELECT CASE WHEN local THEN id END, CASE WHEN NOT local THEN id END, CASE WHEN local THEN 'only_local' ELSE 'only_broker' END, NULL, NULL
  FROM records WHERE id NOT IN (SELECT l FROM pairs UNION ALL SELECT b FROM pairs)""")
def book_reconciliation(spark, sf):
    """Finished orders against open ones: by customer and month where a reference is given, else by class and size within 20 days."""
    return R.reconcile(*A.order_books(spark, sf), 20 * 86_400, F.lit(2000))

"""Captured pages and corporate actions, built from the driver's tables as wire texts and decoded again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.identity import sha256
from ..operators import bars as B
from ..operators import capture as C
from ..schemas import ACTIONS, require
from ..session import staged
from ..sources import adapters as A
from ..sources.tables import driver_table, spread
from .market import SESSIONS, TICKS, UNIVERSE, text_of
from .registry import query

c = F.col

MINUTES = f"""{TICKS}, {SESSIONS}, mins AS (
  SELECT symbol, date_trunc('minute', t) AS t, arg_min(price, (t, id)) AS o, max(price) AS h, min(price) AS l,
         arg_max(price, (t, id)) AS c, CAST(sum(volume) AS BIGINT) AS v, max(received_at) AS received_at
  FROM ticks GROUP BY symbol, date_trunc('minute', t)),
wire AS (
  SELECT symbol, t, o, CASE WHEN minute(t) = 13 THEN 0.001 ELSE h END AS h, l,
         CASE WHEN minute(t) <> 11 THEN c END AS c, v, minute(t) = 7 AS fractional, copy,
         max(received_at) OVER (PARTITION BY symbol, CAST(t - INTERVAL 5 HOUR AS DATE)) AS received_at
  FROM mins, (VALUES (0), (1)) x(copy) WHERE copy = 0 OR minute(t) = 17),
judged AS (
  SELECT w.*, s.session, CASE WHEN symbol = 'ERROR' THEN 'unexpected_symbol' WHEN c IS NULL THEN 'invalid_bar'
    WHEN fractional THEN 'invalid_volume' WHEN l <= 0 OR h < greatest(o, c) THEN 'invalid_minute'
    WHEN copy = 1 THEN 'duplicate_or_unordered_bar' WHEN s.session IS NULL THEN 'outside_session' END AS reject_reason
  FROM wire w LEFT JOIN sessions s ON s.session = CAST(t - INTERVAL 5 HOUR AS DATE) AND t >= market_open AND t < market_close)"""


def _classified(spark, sf):
    """Minutes of the sound pages."""
    rows = staged(C.minute_rows(C.sound_pages(C.page_rejects(A.minute_pages(spark, sf)))), "minute-rows")
    return C.classify_minutes(rows, A.sessions(spark, sf), A.universe(spark))


@query(f"""WITH {MINUTES}
SELECT symbol, {text_of('t')} AS t, CAST(o AS DOUBLE) AS o, CAST(h AS DOUBLE) AS h, CAST(l AS DOUBLE) AS l,
       CAST(c AS DOUBLE) AS c, CASE WHEN NOT fractional THEN v END AS v FROM wire""")
def wire_pages_decode(spark, sf):
    return C.typed_minutes(C.minute_rows(A.minute_pages(spark, sf))).select("symbol", "t", "o", "h", "l", "c", "v")


@query(f"""WITH {MINUTES}
SELECT symbol, {text_of('t')} AS t, reject_reason FROM judged""")
def minute_rejects(spark, sf):
    return _classified(spark, sf).select("symbol", "t", "reject_reason")


@query(f"""WITH {MINUTES}
SELECT symbol, CAST(session AS VARCHAR) AS session, CAST(arg_min(o, t) AS DOUBLE) AS open, CAST(max(h) AS DOUBLE) AS high,
       CAST(min(l) AS DOUBLE) AS low, CAST(arg_max(c, t) AS DOUBLE) AS close, CAST(sum(v) AS BIGINT) AS volume,
       {text_of('max(received_at)')} AS first_ingested_at
FROM judged WHERE reject_reason IS NULL GROUP BY symbol, session""")
def captured_daily_bars(spark, sf):
    accepted = _classified(spark, sf).where(c("reject_reason").isNull()).drop("session")
    bars = B.regular_bars(accepted, A.sessions(spark, sf), "events", "main", "historical", require_complete=False)
    return bars.select("symbol", "session", "open", "high", "low", "close", "volume", "first_ingested_at")


# A session is the first one or two minutes of a day's CLICK ticks, so that complete and incomplete sessions occur.
OPENINGS = """sessions AS (
  SELECT ny AS session, min(date_trunc('minute', t)) AS market_open, min(date_trunc('minute', t)) + INTERVAL 1 MINUTE * (1 + day(ny) % 2) AS market_close
  FROM ticks WHERE symbol = 'CLICK' GROUP BY ny)"""


def _plain_number(column: str) -> str:
    """Digits without trailing zeros."""
    return f"regexp_replace(regexp_replace(CAST({column} AS VARCHAR), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '')"


@query(f"""WITH {MINUTES.replace(SESSIONS, OPENINGS)}, {UNIVERSE},
accepted AS (SELECT *, '{{"c":"' || {_plain_number('c')} || '","h":"' || {_plain_number('h')} || '","l":"' || {_plain_number('l')} || '","o":"' || {_plain_number('o')}
    || '","t":"' || {text_of('t')} || '","v":' || CAST(v AS VARCHAR) || '}}' AS line FROM judged WHERE reject_reason IS NULL),
rolled AS (SELECT symbol, session, count(*) AS n, arg_min(o, t) AS open, max(h) AS high, min(l) AS low, arg_max(c, t) AS close, CAST(sum(v) AS BIGINT) AS volume,
    max(received_at) AS received_at, sha256(string_agg(line, '' ORDER BY t)) AS revision_id FROM accepted GROUP BY symbol, session),
every AS (SELECT symbol, session FROM rolled UNION
    SELECT symbol, session FROM universe, sessions WHERE session >= listed_on AND (delisted_on IS NULL OR session < delisted_on))
SELECT e.symbol, CAST(e.session AS VARCHAR) AS session, {text_of('market_open')} AS interval_start, {text_of('market_close')} AS interval_end,
  datediff('minute', market_open, market_close) AS expected_minutes, coalesce(n, 0) AS observed_minutes,
  CASE WHEN n = datediff('minute', market_open, market_close) THEN NULL ELSE 'missing_minutes' END AS reason,
  CAST(open AS DOUBLE) AS open, CAST(high AS DOUBLE) AS high, CAST(low AS DOUBLE) AS low, CAST(close AS DOUBLE) AS close, volume, revision_id,
  {text_of('r.received_at')} AS first_ingested_at
FROM every e JOIN sessions USING (session) LEFT JOIN rolled r ON r.symbol = e.symbol AND r.session = e.session""")
def captured_bar_verdicts(spark, sf):
    """Complete and incomplete sessions side by side, from sound pages only."""
    sessions = staged(A.opening_minutes(spark, sf), "opening-minutes")
    rows = staged(C.minute_rows(C.sound_pages(C.page_rejects(A.minute_pages(spark, sf)))), "minute-rows")
    accepted = C.classify_minutes(rows, sessions, A.universe(spark)).where(c("reject_reason").isNull()).drop("session")
    bars = B.judged_bars(accepted, sessions, "events", "main", "historical", A.universe(spark))
    return bars.select("symbol", "session", "interval_start", "interval_end", "expected_minutes", "observed_minutes", "reason", "open", "high", "low", "close",
                       "volume", "revision_id", "first_ingested_at")


@query("""SELECT event_id, CASE event_id % 8 WHEN 1 THEN 'empty_page' WHEN 2 THEN 'incomplete_response'
  WHEN 3 THEN 'invalid_response' WHEN 4 THEN 'invalid_response' WHEN 5 THEN 'invalid_pagination'
  WHEN 7 THEN 'invalid_response' END AS reason FROM events""")
def page_rejects(spark, sf):
    events = spread(driver_table(spark, sf, "events"))
    k = F.get_json_object("props", "$.k")
    shape = c("event_id") % 8
    body = (
        F.when(shape == 0, F.concat(F.lit('{"bars": {"X": [{"t": '), k, F.lit('}]}, "next_page_token": null}')))
        .when(shape == 1, F.concat(F.lit('{"bars": {}, "next_page_token": "'), k, F.lit('"}')))
        .when(shape == 2, F.concat(F.lit('{"bars": {"X": ['), k, F.lit(']}}')))
        .when(shape == 3, F.concat(F.lit("not json "), c("props")))
        .when(shape == 4, F.concat(F.lit('{"bars": ['), k, F.lit('], "next_page_token": null}')))
        .when(shape == 5, F.concat(F.lit('{"bars": {"X": [{"t": '), k, F.lit('}]}, "next_page_token": 5}')))
        .when(shape == 6, F.lit('{"bars": null, "next_page_token": null}'))
        .otherwise(F.concat(F.lit('{"bars": {"X": '), k, F.lit('}, "next_page_token": null}')))
    )
    pages = events.select("event_id", F.lit("/v2/stocks/bars").alias("path"), body.alias("body"))
    return C.page_rejects(pages).select("event_id", "reason")


@query(f"""WITH {MINUTES}, placed AS (
  SELECT *, datediff('day', DATE '2023-01-01', CAST(t - INTERVAL 5 HOUR AS DATE)) * 100 + ascii(symbol) AS seq FROM judged)
SELECT seq, symbol, {text_of('t')} AS t, reject_reason AS reason FROM placed WHERE seq % 7 NOT IN (1, 2, 3, 4, 5)
UNION ALL SELECT DISTINCT seq, NULL, NULL, 'invalid_response' FROM placed WHERE seq % 7 IN (1, 2, 3, 4, 5)""")
def capture_rejects(spark, sf):
    """Pages cut off, with a key repeated inside a row, with NaN, with a row that is no object and with a number too long."""
    pages, body, kind = A.minute_pages(spark, sf), c("body"), c("seq") % 7
    added = lambda row: F.regexp_replace(body, r"\]\},", f",{row}]}},")
    broken = (
        F.when(kind == 1, F.expr("substring(body, 1, length(body) - 9)"))
        .when(kind == 2, added('{"t":"x","v":1,"v":2}'))
        .when(kind == 3, added('{"t":"x","o":NaN}'))
        .when(kind == 4, added("5"))
        .when(kind == 5, added('{"t":"x","o":1.0000000000000000001}'))
        .otherwise(body)
    )
    verdicts = C.capture_verdicts(pages.withColumn("body", broken), A.sessions(spark, sf), A.universe(spark))
    return verdicts.select("seq", "symbol", "t", "reason")


@query("""SELECT event_id, CASE WHEN event_id % 4 < 2 THEN 'inexact_number' END AS reason FROM events""")
def inexact_number_rejects(spark, sf):
    """Numbers by value: more than 18 places with and without an exponent, against exponents and zeros that lose nothing."""
    events = driver_table(spark, sf, "events")
    k = F.get_json_object("props", "$.k")
    number = (
        F.when(c("event_id") % 4 == 0, F.concat(F.lit("1"), k, F.lit("1e-19")))
        .when(c("event_id") % 4 == 1, F.concat(F.lit("0.0000000000000000000"), k, F.lit("1")))
        .when(c("event_id") % 4 == 2, F.concat(k, F.lit("e2")))
        .otherwise(F.concat(F.lit("1"), k, F.lit("0000000000000000000.0e-19")))
    )
    return events.select("event_id", C.strict_json_reason(F.concat(F.lit('{"v":'), number, F.lit("}"))).alias("reason"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 1 THEN 'duplicate_key' WHEN 2 THEN 'non_finite_number'
  WHEN 3 THEN 'malformed' END AS reason FROM events""")
def strict_json_rejects(spark, sf):
    events = spread(driver_table(spark, sf, "events"))
    shape = c("event_id") % 5
    head = F.expr("substring(props, 1, length(props) - 1)")
    text = (
        F.when(shape == 1, F.concat(head, F.lit(', "k": 1}')))
        .when(shape == 2, F.concat(head, F.lit(', "x": NaN}')))
        .when(shape == 3, head)
        .when(shape == 4, F.concat(head, F.lit(', "x": "a NaN in text"}')))
        .otherwise(c("props"))
    )
    return events.select("event_id", C.strict_json_reason(text).alias("reason"))


ACTION_ROWS = """spine AS (SELECT min(CAST(o_orderdate AS DATE)) AS lo, max(CAST(o_orderdate AS DATE)) AS hi FROM orders),
a AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 50 = 1 THEN o_orderkey - 1 ELSE o_orderkey END AS id,
    'C' || CAST(o_custkey % 40 AS VARCHAR) AS symbol, CAST(o_orderdate AS DATE) AS day,
    CASE WHEN o_orderkey % 31 <> 0 THEN CAST(o_orderdate AS DATE) END AS ex,
    CAST(o_orderdate AS DATE) + CAST(o_orderkey % 9 - 4 AS INTEGER) AS process, o_totalprice,
    CASE WHEN o_orderkey % 7 < 3 THEN 'split' WHEN o_orderkey % 7 < 6 THEN 'cash_dividend' END AS kind,
    1 + o_orderkey % 2 AS old_rate, 1 + o_orderkey % 5 AS new_rate FROM orders),
b AS (SELECT a.*, coalesce(ex, process) AS eff, coalesce(ex, process) BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' AS hit,
    process BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' AS phit FROM a),
judged AS (SELECT b.*, CASE
    WHEN k % 50 = 1 AND EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = k - 1) THEN 'duplicate_action'
    WHEN kind IS NOT NULL AND ex IS NULL THEN 'incomplete_actions'
    WHEN kind IS NULL AND (hit OR phit) THEN 'unsupported_action'
    WHEN kind IS NULL OR NOT hit THEN 'ignored'
    WHEN CAST(substr(symbol, 2) AS INTEGER) >= 30 OR isodow(eff) > 5
      OR eff NOT BETWEEN (SELECT lo FROM spine) AND (SELECT hi FROM spine) THEN 'action_scope'
    WHEN kind = 'split' AND (new_rate % old_rate <> 0 OR new_rate // old_rate < 2 OR k % 41 = 0) THEN 'unsupported_split'
    WHEN kind = 'cash_dividend' AND (k % 13 = 0 OR k % 17 = 0) THEN 'unsupported_dividend'
    ELSE 'accepted' END AS status FROM b)"""


def _listed(spark, sf):
    customers = driver_table(spark, sf, "customer").where(c("c_custkey") % 40 < 30)
    return customers.select(F.concat(F.lit("C"), (c("c_custkey") % 40).cast("string")).alias("symbol")).distinct()


def _day(text):
    return F.lit(text).cast("date")


def _actions(spark, sf):
    rows = staged(C.action_rows(C.sound_pages(C.judged_pages(A.action_pages(spark, sf)))), "action-rows")
    return C.classify_actions(rows, A.order_sessions(spark, sf), _listed(spark, sf), _day("1996-01-01"), _day("1999-12-31"))


@query(f"""WITH {ACTION_ROWS}
SELECT k AS seq, CAST(id AS VARCHAR) AS action_id, status FROM judged""")
def action_rejects(spark, sf):
    return _actions(spark, sf).select("seq", "action_id", "status")


# Of every eleven pages one is cut off, one repeats a key, one has no token, one holds a number, one is empty.
@query(f"""WITH {ACTION_ROWS.replace("EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = k - 1)", "EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = k - 1 AND o.o_orderkey % 11 NOT IN (1, 2, 3, 4, 5))")}
SELECT k AS seq, CASE WHEN k % 11 NOT IN (1, 2, 3, 4, 5) THEN CAST(id AS VARCHAR) END AS action_id,
  CASE WHEN k % 11 = 3 THEN 'incomplete_response' WHEN k % 11 IN (1, 2, 4) THEN 'invalid_response' WHEN k % 11 <> 5 THEN status END AS status
FROM judged""")
def action_verdicts(spark, sf):
    pages, body, kind = A.action_pages(spark, sf), c("body"), c("seq") % 11
    broken = (
        F.when(kind == 1, F.expr("substring(body, 1, length(body) - 9)"))
        .when(kind == 2, F.regexp_replace(body, '"special"', '"symbol":"X","special"'))
        .when(kind == 3, F.regexp_replace(body, ',"next_page_token":null', ""))
        .when(kind == 4, F.regexp_replace(body, r"\]\},", ",5]},"))
        .when(kind == 5, F.lit('{"corporate_actions":{},"next_page_token":null}'))
        .otherwise(body)
    )
    verdicts = C.action_verdicts(pages.withColumn("body", broken), A.order_sessions(spark, sf), _listed(spark, sf), _day("1996-01-01"), _day("1999-12-31"))
    return verdicts.select("seq", "action_id", "status")


# Fields of the wire in the order of their names; a number with a point is a text of its digits.
WIRE_TEXT = """'{' || CASE WHEN k % 41 = 0 THEN '"due_bill_redemption_date":"' || day || '",' ELSE '' END
  || CASE WHEN ex IS NOT NULL THEN '"ex_date":"' || ex || '",' ELSE '' END || CASE WHEN k % 17 <> 0 THEN '"foreign":false,' ELSE '' END
  || '"id":"' || id || '","new_rate":' || new_rate || ',"old_rate":' || old_rate || ',"payable_date":"' || (day + 10) || '","process_date":"' || process
  || '","rate":' || CASE WHEN o_totalprice = floor(o_totalprice) THEN CAST(CAST(o_totalprice AS BIGINT) AS VARCHAR) ELSE '"' || rtrim(printf('%.8f', o_totalprice), '0') || '"' END
  || ',"special":' || CASE WHEN k % 13 = 0 THEN 'true' ELSE 'false' END || ',"symbol":"' || symbol || '"}'"""


@query(f"""WITH {ACTION_ROWS}
SELECT CAST(id AS VARCHAR) AS action_id, symbol, kind, CAST(eff AS VARCHAR) AS effective_session,
       {text_of("CAST(eff AS TIMESTAMP) + INTERVAL 870 MINUTE")} AS available_at,
       CASE WHEN kind = 'split' THEN CAST(new_rate // old_rate AS BIGINT) END AS split_ratio,
       CASE WHEN kind = 'cash_dividend' THEN o_totalprice END AS cash_amount_usd,
       CASE WHEN kind = 'cash_dividend' THEN CAST(day + 10 AS VARCHAR) END AS pay_date,
       {text_of("CAST(day AS TIMESTAMP)")} AS first_ingested_at, 1 AS schema_version, sha256({WIRE_TEXT}) AS revision_id
FROM judged WHERE status = 'accepted'""")
def corporate_actions(spark, sf):
    return require(C.corporate_actions(_actions(spark, sf)), ACTIONS)


@query("""WITH e AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'user' ELSE 'assistant' END AS role
  FROM (SELECT DISTINCT conv_id FROM conversations), (SELECT unnest([0, 1, 2, 3]) AS turn))
SELECT coalesce(e.conv_id, r.conv_id) AS conv_id, CAST(coalesce(e.turn, r.turn) AS BIGINT) AS turn,
  CASE WHEN r.conv_id IS NULL THEN 'incomplete_capture' WHEN e.conv_id IS NULL THEN 'extra_capture_pages'
       WHEN r.role IS DISTINCT FROM e.role THEN 'capture_request_mismatch' ELSE 'ok' END AS status
FROM e FULL JOIN (SELECT conv_id, turn, role FROM conversations) r ON e.conv_id = r.conv_id AND e.turn = r.turn""")
def page_completeness(spark, sf):
    pages = driver_table(spark, sf, "conversations")
    turns = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(3).cast("bigint"))).alias("turn")
    expected = pages.select("conv_id").distinct().select("conv_id", turns).withColumn(
        "role", F.when(c("turn") % 2 == 0, "user").otherwise("assistant")
    )
    return C.page_completeness(pages, expected, ["conv_id", "turn"], ["role"])


@query("""SELECT conv_id, sha256(text) AS fingerprint, count(*) AS copies FROM conversations
GROUP BY conv_id, sha256(text) HAVING count(*) > 1""")
def repeated_pages(spark, sf):
    return C.repeated_pages(driver_table(spark, sf, "conversations"), ["conv_id"], sha256(c("text")))


RECEIPTS = """latest AS (SELECT o_custkey AS request_id, o_orderkey AS capture_id, o_orderkey + 7 AS dataset_id FROM orders
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)"""


def _receipts(spark, sf):
    return driver_table(spark, sf, "orders").select(
        c("o_custkey").alias("request_id"), c("o_orderkey").alias("capture_id"), (c("o_orderkey") + 7).alias("dataset_id"),
        c("o_orderdate").alias("completed_at"),
    )


@query(f"WITH {RECEIPTS} SELECT * FROM latest")
def latest_receipts(spark, sf):
    return C.latest_receipts(_receipts(spark, sf)).drop("completed_at")


@query(f"""WITH {RECEIPTS}, stored AS (SELECT DISTINCT l_orderkey FROM lineitem)
SELECT c_custkey AS request_id, capture_id, dataset_id, CASE WHEN capture_id IS NULL THEN 'cache_miss'
  WHEN capture_id NOT IN (SELECT l_orderkey FROM stored) OR capture_id % 13 = 0 THEN 'capture_corrupt'
  WHEN capture_id % 11 = 0 OR capture_id % 17 = 0 THEN 'cache_mismatch' ELSE 'hit' END AS status
FROM customer LEFT JOIN latest ON request_id = c_custkey""")
def cache_status(spark, sf):
    requests = driver_table(spark, sf, "customer").select(c("c_custkey").alias("request_id"))
    orders = driver_table(spark, sf, "orders")
    stored = driver_table(spark, sf, "lineitem").select("l_orderkey").distinct()
    key = c("o_orderkey")
    captures = orders.join(stored, key == c("l_orderkey"), "left_semi").select(
        key.alias("capture_id"), F.when(key % 11 == 0, c("o_custkey") + 1).otherwise(c("o_custkey")).alias("request_id"),
        (key % 13 == 0).alias("corrupt"),
    )
    snapshots = orders.select(
        (key + 7).alias("dataset_id"), F.when(key % 17 == 0, key + 1).otherwise(key).alias("capture_id")
    )
    receipts = C.latest_receipts(_receipts(spark, sf)).drop("completed_at")
    return C.cache_status(requests, receipts, captures, snapshots)


@query("""SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2
HAVING count(DISTINCT CAST(l_partkey AS VARCHAR) || '|' || CAST(l_suppkey AS VARCHAR)) > 1""")
def immutable_conflicts(spark, sf):
    content = F.concat_ws("|", c("l_partkey").cast("string"), c("l_suppkey").cast("string"))
    return C.immutable_conflicts(driver_table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], content)


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S.%fZ') AS received_at
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE NOT (l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 60 DAY)""")
def received_outside_capture(spark, sf):
    captures = driver_table(spark, sf, "orders").select(
        c("o_orderkey").alias("capture_id"), c("o_orderdate").alias("requested_at"),
        (c("o_orderdate") + F.expr("INTERVAL 60 DAYS")).alias("captured_at"),
    )
    pages = driver_table(spark, sf, "lineitem").select(
        c("l_orderkey").alias("capture_id"), "l_linenumber", "l_partkey", "l_suppkey", c("l_shipdate").alias("received_at")
    )
    outside = C.received_outside(pages, captures).drop("requested_at", "captured_at")
    return outside.withColumnRenamed("capture_id", "l_orderkey")


@query("""SELECT nation_feed.n_nationkey, array_to_string(list_concat(
  ['unknown_revision_timing', 'historical_availability_assumed', 'historical_action_timing_assumed',
   'provider_action_completeness_unverified', 'fixed_declared_universe', 'regular_minutes_aggregation',
   'closing_boundary_auction_excluded'],
  CASE WHEN n_nationkey % 2 = 0 THEN ['synthetic_data'] ELSE [] END,
  CASE WHEN n_nationkey % 3 = 0 THEN ['single_exchange_iex'] ELSE [] END), ',') AS limitations FROM nation nation_feed""")
def limitation_tags(spark, sf):
    key = c("n_nationkey")
    origin = F.when(key % 2 == 0, "synthetic").otherwise("historical")
    feed = F.when(key % 3 == 0, "iex").otherwise("sip")
    return driver_table(spark, sf, "nation").select(key, C.limitation_tags(origin, feed).alias("limitations"))


@query("""WITH p AS (SELECT conv_id, turn AS seq,
    CASE WHEN conv_id % 7 = 0 AND turn = 2 THEN 'x' WHEN turn > 0 THEN 'n' || turn END AS requested,
    CASE WHEN conv_id % 5 = 0 AND turn = 1 THEN NULL WHEN conv_id % 13 = 0 AND turn = 2 THEN 'n2' ELSE 'n' || (turn + 1) END AS token
  FROM conversations WHERE NOT (conv_id % 11 = 0 AND turn = 1)),
again AS (SELECT conv_id, token FROM p WHERE token IS NOT NULL GROUP BY conv_id, token HAVING count(*) > 1)
SELECT p.conv_id, CAST(p.seq AS BIGINT) AS seq, CASE WHEN p.seq > 0 AND b.conv_id IS NULL THEN 'incomplete_capture'
  WHEN p.seq > 0 AND b.token IS NULL THEN 'extra_capture_pages' WHEN p.requested IS DISTINCT FROM b.token THEN 'capture_request_mismatch'
  WHEN again.token IS NOT NULL THEN 'repeated_token' ELSE 'ok' END AS status
FROM p LEFT JOIN p b ON b.conv_id = p.conv_id AND b.seq + 1 = p.seq LEFT JOIN again ON again.conv_id = p.conv_id AND again.token = p.token
UNION ALL SELECT b.conv_id, CAST(b.seq + 1 AS BIGINT), 'incomplete_capture' FROM p b
WHERE b.token IS NOT NULL AND NOT EXISTS (SELECT 1 FROM p WHERE p.conv_id = b.conv_id AND p.seq = b.seq + 1)""")
def page_chain(spark, sf):
    conv, turn = c("conv_id"), c("turn")
    numbered = lambda n: F.concat(F.lit("n"), n.cast("string"))
    pages = driver_table(spark, sf, "conversations").where(~((conv % 11 == 0) & (turn == 1))).select(
        "conv_id", turn.cast("bigint").alias("seq"),
        F.when((conv % 7 == 0) & (turn == 2), "x").when(turn > 0, numbered(turn)).alias("requested_token"),
        F.when((conv % 5 == 0) & (turn == 1), F.lit(None)).when((conv % 13 == 0) & (turn == 2), "n2").otherwise(numbered(turn + 1)).alias("token"),
    )
    return C.page_chain(pages, ["conv_id"])

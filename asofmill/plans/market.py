"""Bars, calendars, quality and point-in-time views over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.clocks import utc_text
from ..functions.exact import adverse_price, number_text
from ..functions.identity import sha256, table_digest
from ..functions.ordered import latest_as_of
from ..functions.rules import duplicate_keys, violations
from ..operators import bars as B
from ..operators import calendars as K
from ..operators import pointintime as P
from ..operators import quality as Q
from ..operators import records
from ..operators.versions import rows_differ
from ..sources import adapters as A
from ..sources.tables import driver_table, spread
from .registry import query

c = F.col

# ---- shared SQL ------------------------------------------------------------------------------------------------
# The events lie in January, when New York is five hours behind UTC.
TICKS = """ticks AS (
  SELECT upper(event_type) AS symbol, ts AS t, CAST(value AS DECIMAL(24,8)) AS price,
         CAST(regexp_extract(props, '(-?[0-9]+)', 1) AS BIGINT) AS volume, event_id AS id, user_id,
         ts + INTERVAL 1 HOUR AS received_at, CAST(ts - INTERVAL 5 HOUR AS DATE) AS ny
  FROM events)"""
SESSIONS = """bounds AS (SELECT min(CAST(ts AS DATE)) AS lo, max(CAST(ts AS DATE)) AS hi FROM events),
sessions AS (
  SELECT CAST(d AS DATE) AS session, d + INTERVAL 870 MINUTE AS market_open,
         CASE WHEN isodow(d) = 5 THEN d + INTERVAL 18 HOUR ELSE d + INTERVAL 21 HOUR END AS market_close
  FROM (SELECT unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS d FROM bounds)
  WHERE isodow(d) < 6 AND CAST(d AS DATE) NOT IN (DATE '2024-01-01', DATE '2024-01-15'))"""
UNIVERSE = """universe(symbol, listed_on, delisted_on) AS (VALUES
  ('CLICK', DATE '2020-01-01', CAST(NULL AS DATE)), ('VIEW', DATE '2020-01-01', NULL),
  ('PURCHASE', DATE '2024-01-05', NULL), ('SIGNUP', DATE '2020-01-01', DATE '2024-01-25'),
  ('REFUND', DATE '2024-01-20', NULL))"""
ACTIONS = """actions(action_id, symbol, kind, day, ratio, amount, pay_date, delay) AS (VALUES
  ('s1', 'CLICK', 'split', DATE '2024-01-09', 2, NULL, NULL, 1),
  ('s2', 'CLICK', 'split', DATE '2024-01-22', 4, NULL, NULL, 1),
  ('s3', 'ERROR', 'split', DATE '2024-01-10', 2, NULL, NULL, 1),
  ('s4', 'PURCHASE', 'split', DATE '2024-01-20', 2, NULL, NULL, 1),
  ('s5', 'VIEW', 'split', DATE '2024-01-16', 2, NULL, NULL, 40),
  ('d1', 'VIEW', 'cash_dividend', DATE '2024-01-11', NULL, 0.5, DATE '2024-01-19', 1),
  ('d2', 'CLICK', 'cash_dividend', DATE '2024-01-18', NULL, 1.25, DATE '2024-02-02', 1))"""
MARKET_BARS = f"""{TICKS}, {SESSIONS}, market_bars AS (
  SELECT symbol, session, arg_min(price, (t, id)) AS open, max(price) AS high, min(price) AS low,
         arg_max(price, (t, id)) AS close, CAST(sum(volume) AS BIGINT) AS volume,
         max(received_at) AS first_ingested_at, min(market_open) AS interval_start, min(market_close) AS interval_end,
         min(market_close) + INTERVAL 15 MINUTE AS available_at
  FROM ticks JOIN sessions ON ny = session AND t >= market_open AND t < market_close
  WHERE price > 0 GROUP BY symbol, session)"""
DECLARED_BARS = f"""{TICKS}, {SESSIONS}, declared_bars AS (
  SELECT symbol, ny AS session, arg_min(price, (t, id)) AS open, max(price) AS high, min(price) AS low,
         arg_max(price, (t, id)) AS close, CAST(sum(volume) AS BIGINT) AS volume,
         max(received_at) AS first_ingested_at, CAST(ny AS TIMESTAMP) + INTERVAL 870 MINUTE AS interval_start,
         CAST(ny AS TIMESTAMP) + INTERVAL 21 HOUR AS interval_end,
         CAST(ny AS TIMESTAMP) + INTERVAL 1275 MINUTE AS available_at,
         CASE WHEN symbol = 'VIEW' AND day(ny) % 10 = 3 THEN 'alt' ELSE 'main' END AS feed
  FROM ticks WHERE price > 0 GROUP BY symbol, ny)"""


def text_of(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%dT%H:%M:%S.%fZ')"


def dbl(column: str, alias: str | None = None) -> str:
    return f"CAST({column} AS DOUBLE) AS {alias or column}"


PRICES = ", ".join(dbl(n) for n in ("open", "high", "low", "close"))


# ---- bars ------------------------------------------------------------------------------------------------------
@query(f"""WITH {MARKET_BARS}
SELECT symbol, CAST(session AS VARCHAR) AS session, {PRICES}, volume,
       {text_of('available_at')} AS available_at, {text_of('first_ingested_at')} AS first_ingested_at,
       {text_of('interval_start')} AS interval_start, {text_of('interval_end')} AS interval_end
FROM market_bars""")
def daily_bars(spark, sf):
    return A.market_bars(spark, sf)


def _interval_sql(unit: str) -> str:
    return f"""WITH {TICKS}
SELECT symbol, {text_of(f"CAST(date_trunc('{unit}', t) AS TIMESTAMP)")} AS bucket,
       CAST(arg_min(price, (t, id)) AS DOUBLE) AS open, CAST(max(price) AS DOUBLE) AS high,
       CAST(min(price) AS DOUBLE) AS low, CAST(arg_max(price, (t, id)) AS DOUBLE) AS close,
       CAST(sum(volume) AS BIGINT) AS volume
FROM ticks GROUP BY symbol, date_trunc('{unit}', t)"""


@query(_interval_sql("hour"))
def hourly_bars(spark, sf):
    return B.interval_bars(A.ticks(spark, sf), "HOUR")


@query(_interval_sql("week"))
def weekly_bars(spark, sf):
    return B.interval_bars(A.ticks(spark, sf), "WEEK")


@query(f"""WITH {MARKET_BARS}
SELECT symbol, count(*) AS bars, CAST(min(session) AS VARCHAR) AS first_session,
       CAST(max(session) AS VARCHAR) AS last_session, count(*) FILTER (WHERE volume = 0) AS zero_volume_bars
FROM market_bars GROUP BY symbol ORDER BY symbol""")
def coverage_report(spark, sf):
    return B.coverage_report(A.market_bars(spark, sf))


@query(f"""WITH {TICKS}, {SESSIONS}, {UNIVERSE}, m AS (
  SELECT DISTINCT symbol, session, date_trunc('minute', t) AS minute
  FROM ticks JOIN sessions ON ny = session AND t >= market_open AND t < market_close),
grid AS (
  SELECT u.symbol, s.session, g.minute FROM universe u, sessions s,
    LATERAL (SELECT unnest(generate_series(s.market_open, s.market_close - INTERVAL 1 MINUTE, INTERVAL 1 MINUTE)) AS minute) g
  WHERE s.session >= u.listed_on AND (u.delisted_on IS NULL OR s.session < u.delisted_on)
  UNION
  SELECT x.symbol, s.session, g.minute FROM (SELECT DISTINCT symbol, session FROM m) x JOIN sessions s USING (session),
    LATERAL (SELECT unnest(generate_series(s.market_open, s.market_close - INTERVAL 1 MINUTE, INTERVAL 1 MINUTE)) AS minute) g)
SELECT g.symbol, CAST(g.session AS VARCHAR) AS session, count(*) AS expected_minutes, count(m.minute) AS observed_minutes,
       count(*) - count(m.minute) AS missing_minutes,
       {text_of("min(g.minute) FILTER (WHERE m.minute IS NULL)")} AS first_missing
FROM grid g LEFT JOIN m ON g.symbol = m.symbol AND g.minute = m.minute GROUP BY g.symbol, g.session""")
def missing_minutes(spark, sf):
    minutes = B.minute_bars(A.ticks(spark, sf))
    return B.minute_completeness(minutes, A.sessions(spark, sf), A.universe(spark))


@query(f"""WITH {TICKS}, minutes AS (
  SELECT symbol, date_trunc('minute', t) AS minute, CAST(sum(volume) AS BIGINT) AS v, count(*) AS n
  FROM ticks GROUP BY symbol, date_trunc('minute', t))
SELECT symbol, CAST(CAST(minute AS DATE) AS VARCHAR) AS day, count(*) AS minutes,
       sha256(string_agg({text_of('minute')} || '|' || CAST(v AS VARCHAR) || ';', '' ORDER BY minute)) AS content_sha256
FROM minutes GROUP BY symbol, CAST(minute AS DATE)""")
def group_content_hash(spark, sf):
    minutes = B.minute_bars(A.ticks(spark, sf)).withColumn("day", F.to_date("t"))
    line = F.concat(utc_text(c("t")), F.lit("|"), c("volume").cast("string"), F.lit(";"))
    return B.group_content_hash(minutes, ["symbol", "day"], line, "t")


@query(f"""WITH {MARKET_BARS}, h AS (
  SELECT symbol, sha256('{{"session":"' || CAST(session AS VARCHAR) || '","symbol":"' || symbol || '","volume":'
    || CAST(volume AS VARCHAR) || '}}') AS d FROM market_bars),
w AS (SELECT symbol, count(*) AS n, {", ".join(f"CAST(sum(CAST('0x' || substr(d, {1 + 4 * i}, 4) AS INTEGER)) AS BIGINT) AS w{i}" for i in range(16))}
  FROM h GROUP BY symbol)
SELECT symbol, n AS "rows", sha256(concat_ws('|', n, {", ".join(f"w{i}" for i in range(16))})) AS digest FROM w""")
def dataset_identity(spark, sf):
    rows = A.market_bars(spark, sf).select("symbol", "session", "volume")
    return table_digest(rows, by=["symbol"])


@query(f"""WITH {TICKS}
SELECT id, CAST(round(price * 1.001, 2) AS DOUBLE) AS buy_price, CAST(round(price * 0.999, 2) AS DOUBLE) AS sell_price
FROM ticks WHERE price > 0""")
def adverse_fill_price(spark, sf):
    ticks = A.ticks(spark, sf).where(c("price") > 0)
    return ticks.select(
        "id", adverse_price(c("price"), 10, F.lit("buy")).alias("buy_price"),
        adverse_price(c("price"), 10, F.lit("sell")).alias("sell_price"),
    )


@query("""SELECT event_id, CASE WHEN cents % 100 = 0 THEN CAST(cents // 100 AS VARCHAR)
  WHEN cents % 10 = 0 THEN CAST(cents // 100 AS VARCHAR) || '.' || CAST((cents % 100) // 10 AS VARCHAR)
  ELSE CAST(cents // 100 AS VARCHAR) || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') END AS canonical
FROM (SELECT event_id, CAST(round(value * 100) AS BIGINT) AS cents FROM events)""")
def canonical_decimal_text(spark, sf):
    events = driver_table(spark, sf, "events")
    return events.select("event_id", number_text(c("value").cast("decimal(24,8)")).alias("canonical"))


# ---- calendars -------------------------------------------------------------------------------------------------
@query(f"""WITH {SESSIONS}
SELECT CAST(CAST(d AS DATE) AS VARCHAR) AS closed_on
FROM (SELECT unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS d FROM bounds)
WHERE CAST(d AS DATE) BETWEEN (SELECT min(session) FROM sessions) AND (SELECT max(session) FROM sessions)
  AND CAST(d AS DATE) NOT IN (SELECT session FROM sessions)""")
def expected_closures(spark, sf):
    return K.closures(A.sessions(spark, sf))


@query(f"""WITH {SESSIONS}
SELECT CAST(session AS VARCHAR) AS session FROM sessions WHERE market_close - market_open < INTERVAL 390 MINUTE""")
def shortened_sessions(spark, sf):
    return K.shortened(A.sessions(spark, sf))


@query(f"""WITH {SESSIONS}, r AS (
  SELECT n_nationkey, DATE '2024-01-02' + n_nationkey AS fe, n_nationkey % 6 AS w FROM nation)
SELECT n_nationkey, CAST(fe AS VARCHAR) AS first_execution_session, CAST(w AS BIGINT) AS warmup_sessions,
       (SELECT count(*) FROM sessions WHERE session < fe) AS prior_sessions,
       (SELECT count(*) FROM sessions WHERE session < fe) >= w AS enough_warmup,
       fe IN (SELECT session FROM sessions) AS is_execution_session,
       CAST(CASE WHEN w > 0 AND (SELECT count(*) FROM sessions WHERE session < fe) >= w
         THEN (SELECT s.session FROM sessions s WHERE s.session < fe
               AND (SELECT count(*) FROM sessions z WHERE z.session < fe AND z.session >= s.session) = w)
         ELSE fe END AS VARCHAR) AS required_start
FROM r""")
def warmup_start(spark, sf):
    nation = driver_table(spark, sf, "nation")
    requests = nation.select(
        "n_nationkey", F.date_add(F.lit("2024-01-02").cast("date"), c("n_nationkey")).alias("first_execution_session"),
        (c("n_nationkey") % 6).cast("bigint").alias("warmup_sessions"),
    )
    return K.warmup_start(requests, A.sessions(spark, sf))


REQUESTS = """requests AS (
  SELECT c_custkey AS request_id, DATE '2024-01-02' + CAST(c_custkey % 10 AS INTEGER) AS s,
         DATE '2024-01-02' + CAST(c_custkey % 10 + c_custkey % 15 AS INTEGER) AS e,
         DATE '2024-01-02' + CAST(c_custkey % 10 + c_custkey % 7 AS INTEGER) AS fe, c_custkey % 4 AS w,
         TIMESTAMP '2024-01-23 12:00:00' AS requested_at, DATE '2024-01-01' + CAST(c_custkey % 20 AS INTEGER) AS listed_on,
         CASE WHEN c_custkey % 3 = 0 THEN DATE '2024-01-21' + CAST(c_custkey % 9 AS INTEGER) END AS delisted_on
  FROM customer)"""


def _requests(spark, sf):
    key = c("c_custkey")
    base = F.lit("2024-01-02").cast("date")
    start = F.date_add(base, (key % 10).cast("int"))
    return driver_table(spark, sf, "customer").select(
        key.alias("request_id"), start.alias("start_session"), F.date_add(start, (key % 15).cast("int")).alias("end_session"),
        F.date_add(start, (key % 7).cast("int")).alias("first_execution_session"), (key % 4).alias("warmup_sessions"),
        F.lit("2024-01-23 12:00:00").cast("timestamp").alias("requested_at"),
        F.date_add(F.lit("2024-01-01").cast("date"), (key % 20).cast("int")).alias("listed_on"),
        F.when(key % 3 == 0, F.date_add(F.lit("2024-01-21").cast("date"), (key % 9).cast("int"))).alias("delisted_on"),
        F.concat(F.lit("S"), (key % 9).cast("string")).alias("symbols"),
    )


@query(f"""WITH {SESSIONS}, {REQUESTS}, x AS (
  SELECT r.*, (SELECT max(market_close) FROM sessions WHERE session BETWEEN s AND e) AS last_close,
         (SELECT count(*) FROM sessions WHERE session BETWEEN s AND e AND session < fe) AS prior,
         (SELECT list(session ORDER BY session DESC) FROM sessions WHERE session BETWEEN s AND e AND session < fe) AS before
  FROM requests r)
SELECT request_id, CASE
  WHEN last_close IS NULL OR last_close + INTERVAL 15 MINUTE > requested_at THEN 'unfinished_range'
  WHEN fe NOT IN (SELECT session FROM sessions) OR fe > e OR prior < w THEN 'insufficient_warmup'
  WHEN listed_on > CASE WHEN w > 0 THEN before[w] ELSE fe END OR (delisted_on IS NOT NULL AND delisted_on <= e)
    THEN 'listing_coverage' END AS reason FROM x""")
def request_rejects(spark, sf):
    return K.request_rejects(_requests(spark, sf), A.sessions(spark, sf)).select("request_id", "reason")


@query(f"""WITH {SESSIONS}, {REQUESTS}
SELECT request_id, '/v2/stocks/bars' AS path, 'S' || CAST(request_id % 9 AS VARCHAR) AS symbols,
       {text_of('market_open')} AS start, {text_of("market_close - INTERVAL 1 MICROSECOND")} AS "end"
FROM requests JOIN sessions ON session BETWEEN s AND e
UNION ALL
SELECT request_id, '/v1/corporate-actions', 'S' || CAST(request_id % 9 AS VARCHAR), '1970-01-01', '2024-01-23' FROM requests""")
def expected_pages(spark, sf):
    pages = K.expected_pages(_requests(spark, sf), A.sessions(spark, sf))
    is_bars = c("path") == "/v2/stocks/bars"
    return pages.withColumn("start", F.when(is_bars, utc_text(c("start").cast("timestamp"))).otherwise(c("start")))


# ---- quality ---------------------------------------------------------------------------------------------------
@query(f"""WITH {DECLARED_BARS}, {UNIVERSE}, grid AS (
  SELECT symbol, session FROM universe, sessions
  WHERE session >= listed_on AND (delisted_on IS NULL OR session < delisted_on))
SELECT u.symbol, (SELECT count(*) FROM grid g WHERE g.symbol = u.symbol) AS expected_bars,
       (SELECT count(*) FROM declared_bars b WHERE b.symbol = u.symbol) AS observed_bars,
       coalesce((SELECT string_agg(CAST(g.session AS VARCHAR), ',' ORDER BY g.session) FROM grid g
        WHERE g.symbol = u.symbol AND NOT EXISTS (
          SELECT 1 FROM declared_bars b WHERE b.symbol = g.symbol AND b.session = g.session)), '') AS missing_sessions
FROM universe u""")
def session_coverage(spark, sf):
    return Q.session_coverage(A.universe(spark), A.declared_bars(spark, sf), A.sessions(spark, sf))


@query(f"""WITH {MARKET_BARS}, {UNIVERSE}
SELECT symbol, CAST(session AS VARCHAR) AS session FROM universe u, sessions s
WHERE session >= listed_on AND (delisted_on IS NULL OR session < delisted_on)
  AND NOT EXISTS (SELECT 1 FROM market_bars b WHERE b.symbol = u.symbol AND b.session = s.session)""")
def missing_sessions(spark, sf):
    return K.missing_sessions(A.universe(spark), A.market_bars(spark, sf), A.sessions(spark, sf))


@query(f"""WITH {DECLARED_BARS}
SELECT symbol, CAST(session AS VARCHAR) AS session FROM declared_bars
WHERE session NOT IN (SELECT session FROM sessions)""")
def unknown_session_bars(spark, sf):
    known = F.broadcast(A.sessions(spark, sf).select("session"))
    return A.declared_bars(spark, sf).join(known, "session", "left_anti").select("symbol", "session")


GAPS = """p AS (SELECT symbol, session, open, lag(close) OVER (PARTITION BY symbol ORDER BY session) AS previous_close FROM declared_bars),
gaps AS (SELECT p.*, coalesce(a.ratio, 1) AS split_ratio FROM p LEFT JOIN actions a
  ON a.kind = 'split' AND a.symbol = p.symbol AND a.day = p.session
  WHERE previous_close IS NOT NULL AND abs(open * coalesce(a.ratio, 1) - previous_close) * 10 >= previous_close * 2)"""


@query(f"""WITH {DECLARED_BARS}, {ACTIONS}, {GAPS}
SELECT symbol, CAST(session AS VARCHAR) AS session, {dbl('open')}, {dbl('previous_close')}, CAST(split_ratio AS BIGINT) AS ratio FROM gaps""")
def opening_gaps(spark, sf):
    splits = A.actions(spark).where(c("kind") == "split")
    return Q.opening_gaps(A.declared_bars(spark, sf), splits)


FINDINGS = f"""{DECLARED_BARS}, {UNIVERSE}, {ACTIONS}, {GAPS},
b AS (SELECT d.*, s.market_open, s.market_close, u.listed_on, u.delisted_on FROM declared_bars d
  LEFT JOIN sessions s ON s.session = d.session LEFT JOIN universe u ON u.symbol = d.symbol),
findings AS (
  SELECT 'error' AS severity, 'bar_provenance' AS code, symbol, session FROM b WHERE feed <> 'main'
  UNION ALL SELECT 'error', 'unlisted_bar', symbol, session FROM b
    WHERE listed_on IS NULL OR session < listed_on OR coalesce(session >= delisted_on, false)
  UNION ALL SELECT 'error', 'unknown_session', symbol, session FROM b WHERE market_open IS NULL
  UNION ALL SELECT 'error', 'session_hours', symbol, session FROM b
    WHERE market_open IS NOT NULL AND (interval_start <> market_open OR interval_end <> market_close)
  UNION ALL SELECT 'error', 'retrieval_timing', symbol, session FROM b WHERE first_ingested_at > TIMESTAMP '2024-01-28'
  UNION ALL SELECT 'warning', 'zero_volume', symbol, session FROM b WHERE volume = 0
  UNION ALL SELECT 'error', 'action_session', a.symbol, NULL FROM actions a LEFT JOIN universe u ON u.symbol = a.symbol
    WHERE u.symbol IS NULL OR a.day NOT IN (SELECT session FROM sessions) OR a.day < u.listed_on OR coalesce(a.day >= u.delisted_on, false)
  UNION ALL SELECT 'error', 'action_retrieval_timing', symbol, NULL FROM actions
    WHERE CAST(day AS TIMESTAMP) + INTERVAL 870 MINUTE + to_days(delay) > TIMESTAMP '2024-01-28'
  UNION ALL SELECT 'error', 'insufficient_warmup', NULL, NULL
  UNION ALL SELECT 'error', 'listing_coverage', symbol, NULL FROM universe
    WHERE listed_on > DATE '2024-01-04' OR coalesce(delisted_on <= DATE '2024-01-30', false)
  UNION ALL SELECT DISTINCT 'error', 'missing_bars', u.symbol, CAST(NULL AS DATE) FROM universe u, sessions s
    WHERE s.session >= listed_on AND (delisted_on IS NULL OR s.session < delisted_on)
      AND NOT EXISTS (SELECT 1 FROM declared_bars d WHERE d.symbol = u.symbol AND d.session = s.session)
  UNION ALL SELECT 'warning', 'large_opening_gap', symbol, session FROM gaps
  UNION ALL SELECT 'error', 'incomplete_actions', NULL, NULL
  UNION ALL SELECT 'warning', 'unknown_revision_timing', NULL, NULL)"""


def _findings(spark, sf):
    return Q.quality_findings(
        A.PLAN, A.universe(spark), A.declared_bars(spark, sf), A.actions(spark), A.sessions(spark, sf)
    )


@query(f"WITH {FINDINGS} SELECT severity, code, symbol, CAST(session AS VARCHAR) AS session FROM findings")
def quality_findings(spark, sf):
    return _findings(spark, sf)


@query(f"WITH {FINDINGS} SELECT coalesce(NOT bool_or(severity = 'error'), true) AS usable FROM findings")
def quality_usable(spark, sf):
    return Q.is_usable(_findings(spark, sf))


@query(f"""WITH {MARKET_BARS}
SELECT symbol, CAST(session AS VARCHAR) AS session, 'clock_order' AS reason FROM market_bars
WHERE NOT (interval_start < interval_end AND interval_end <= available_at AND available_at <= first_ingested_at)""")
def bar_constraints(spark, sf):
    return violations(A.market_bars(spark, sf), ["symbol", "session"], records.bar_rules())


@query("""SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def duplicate_keys_report(spark, sf):
    return duplicate_keys(driver_table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""SELECT event_id FROM (SELECT event_id, (event_type, ts) AS k,
  lag((event_type, ts)) OVER (ORDER BY event_id) AS p FROM events) WHERE p IS NOT NULL AND k <= p""")
def unordered_rows(spark, sf):
    rows = driver_table(spark, sf, "events").select("event_type", "ts", "event_id")
    # Each row is identified by its arrival number, so the faulty keys are matched back on it.
    faults = Q.sequence_faults(rows, ["event_type", "ts"], "event_id")
    return rows.join(faults, ["event_type", "ts"], "left_semi").select("event_id")


# ---- point in time ---------------------------------------------------------------------------------------------
CUTOFF = "2024-01-20 00:00:00"


def _at(text: str):
    return F.lit(text).cast("timestamp")


@query(f"""WITH {MARKET_BARS}, {ACTIONS}, eff AS (
  SELECT a.* FROM actions a JOIN sessions s ON s.session = a.day WHERE kind = 'split' AND s.market_open <= TIMESTAMP '{CUTOFF}'),
f AS (SELECT b.*, (SELECT coalesce(CAST(product(ratio) AS BIGINT), 1) FROM eff e WHERE e.symbol = b.symbol AND e.day > b.session) AS k,
        (SELECT max(CAST(day AS TIMESTAMP) + INTERVAL 870 MINUTE) FROM eff e WHERE e.symbol = b.symbol AND e.day > b.session) AS known
  FROM market_bars b WHERE available_at <= TIMESTAMP '{CUTOFF}')
SELECT symbol, CAST(session AS VARCHAR) AS session, {text_of('greatest(available_at, known)')} AS available_at,
       k AS split_factor, CAST(open AS DOUBLE) / k AS open, CAST(high AS DOUBLE) / k AS high,
       CAST(low AS DOUBLE) / k AS low, CAST(close AS DOUBLE) / k AS close FROM f""")
def split_adjusted_view(spark, sf):
    return P.split_adjusted_view(A.market_bars(spark, sf), A.actions(spark), A.sessions(spark, sf), _at(CUTOFF))


@query(f"""WITH {SESSIONS}, {ACTIONS}
SELECT action_id, a.symbol, CAST(day AS VARCHAR) AS effective_session,
       CAST(day AS TIMESTAMP) + INTERVAL 870 MINUTE > TIMESTAMP '{CUTOFF}' AS late
FROM actions a JOIN sessions s ON s.session = a.day WHERE kind = 'split' AND s.market_open <= TIMESTAMP '{CUTOFF}'""")
def effective_splits(spark, sf):
    splits = P.effective_splits(A.actions(spark), A.sessions(spark, sf), _at(CUTOFF))
    late = P.late_splits(splits, _at(CUTOFF)).select("action_id", F.lit(True).alias("late"))
    return splits.join(late, "action_id", "left").select(
        "action_id", "symbol", "effective_session", F.coalesce("late", F.lit(False)).alias("late")
    )


NOW = "2024-01-17 21:15:00"


@query(f"""WITH {MARKET_BARS}, {ACTIONS}, f AS (
  SELECT symbol, session, available_at, close, (SELECT coalesce(CAST(product(ratio) AS BIGINT), 1) FROM actions a JOIN sessions s ON s.session = a.day
    WHERE kind = 'split' AND a.symbol = b.symbol AND s.market_open <= TIMESTAMP '{NOW}' AND a.day > b.session) AS k
  FROM market_bars b WHERE available_at < TIMESTAMP '{NOW}')
SELECT symbol, CAST(session AS VARCHAR) AS session, {text_of('available_at')} AS available_at, CAST(close AS DOUBLE) / k AS feature_close FROM f""")
def completed_features(spark, sf):
    features = A.market_bars(spark, sf).select("symbol", "session", "available_at", c("close").alias("feature_close"))
    splits = P.effective_splits(A.actions(spark), A.sessions(spark, sf), _at(NOW))
    return P.completed_features(features, splits, _at(NOW))


@query(f"""WITH {MARKET_BARS}
SELECT symbol, CAST(session AS VARCHAR) AS session, {text_of('available_at')} AS available_at, CAST(close AS DOUBLE) AS close
FROM market_bars WHERE available_at < TIMESTAMP '{NOW}'
QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY available_at DESC, session DESC) = 1""")
def last_visible_bar(spark, sf):
    bars = A.market_bars(spark, sf).select("symbol", "session", "available_at", "close")
    return P.last_visible(P.as_of(bars, _at(NOW), strict=True), ["symbol"])


@query(f"""WITH {MARKET_BARS}
SELECT symbol, count(*) FILTER (WHERE available_at <= TIMESTAMP '{NOW}') AS inclusive_rows,
       count(*) FILTER (WHERE available_at < TIMESTAMP '{NOW}') AS strict_rows FROM market_bars
WHERE available_at <= TIMESTAMP '{NOW}' GROUP BY symbol""")
def strict_vs_inclusive_asof(spark, sf):
    visible = P.as_of(A.market_bars(spark, sf), _at(NOW))
    return visible.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("inclusive_rows"), F.count_if(c("available_at") < _at(NOW)).alias("strict_rows")
    )


def _asof_sql(comparison: str) -> str:
    return f"""WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'),
r AS (SELECT user_id, ts, event_id, value FROM events WHERE event_type IN ('view', 'click'))
SELECT l.event_id, l.user_id, r.event_id AS asof_event_id, r.value AS asof_price
FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts {comparison} r.ts"""


def _asof(spark, sf, strict):
    events = driver_table(spark, sf, "events")
    left = events.where(c("event_type") == "purchase").select("event_id", "user_id", "ts")
    right = events.where(c("event_type").isin("view", "click")).select(
        "event_id", "user_id", "ts", c("value").cast("decimal(24,8)").alias("price")
    )
    found = latest_as_of(left, right, ["user_id"], "ts", "ts", ["event_id", "price"], strict=strict, tie_break=["event_id"])
    return found.select("event_id", "user_id", "asof_event_id", "asof_price")


@query(_asof_sql(">="))
def asof_latest_feature(spark, sf):
    return _asof(spark, sf, strict=False)


@query(_asof_sql(">"))
def asof_strictly_before(spark, sf):
    return _asof(spark, sf, strict=True)


@query(f"""WITH {DECLARED_BARS}, f AS (
  SELECT symbol, session, close, available_at + to_hours(CAST(day(session) % 3 AS INTEGER) - 1) AS f_available,
         available_at + to_hours(CAST(day(session) % 4 AS INTEGER) * 6) AS computed_at FROM declared_bars),
m AS (SELECT * FROM market_bars_only)
SELECT f.symbol, CAST(f.session AS VARCHAR) AS session, CASE WHEN m.symbol IS NULL THEN 'no_observation'
  WHEN f_available < m.available_at THEN 'available_before_observation'
  WHEN computed_at < m.first_ingested_at THEN 'computed_before_ingestion' END AS reason
FROM f LEFT JOIN m ON m.symbol = f.symbol AND m.session = f.session""".replace(
    "m AS (SELECT * FROM market_bars_only)", MARKET_BARS[MARKET_BARS.index("market_bars AS"):].replace("market_bars AS", "m AS", 1)))
def feature_source_match(spark, sf):
    hours = lambda n: F.make_dt_interval(F.lit(0), n)
    day = F.dayofmonth("session")
    features = A.declared_bars(spark, sf).select(
        "symbol", "session", F.lit("d").alias("dataset_id"), (c("available_at") + hours(day % 3 - 1)).alias("available_at"),
        (c("available_at") + hours(day % 4 * 6)).alias("computed_at"),
    )
    observations = A.market_bars(spark, sf).withColumn("dataset_id", F.lit("d"))
    return P.match_observations(features, observations).select("symbol", "session", "reason")


@query(f"""WITH {TICKS}
SELECT symbol, CAST(user_id AS BIGINT) AS user_id, id, CAST(price AS DOUBLE) AS price FROM ticks
QUALIFY row_number() OVER (PARTITION BY symbol, user_id ORDER BY received_at DESC, id DESC) = 1""")
def latest_revision(spark, sf):
    rows = A.ticks(spark, sf).select("symbol", "user_id", "id", "price", "received_at")
    return P.latest_version(rows, ["symbol", "user_id"], "received_at", "id").drop("received_at")


@query(f"""WITH {TICKS}
SELECT symbol, CAST(user_id AS BIGINT) AS user_id, id, CAST(price AS DOUBLE) AS price FROM ticks
WHERE received_at <= TIMESTAMP '{CUTOFF}'
QUALIFY row_number() OVER (PARTITION BY symbol, user_id ORDER BY received_at DESC, id DESC) = 1""")
def revision_as_of(spark, sf):
    rows = A.ticks(spark, sf).select("symbol", "user_id", "id", "price", "received_at")
    found = P.latest_version_as_of(rows, ["symbol", "user_id"], _at(CUTOFF), "received_at", "id")
    return found.drop("received_at")


@query(f"""WITH {MARKET_BARS}
SELECT CAST(0 AS BIGINT) AS differing_rows""")
def future_poison(spark, sf):
    """Rows after the cutoff are poisoned; the adjusted view at the cutoff must not change."""
    bars = A.market_bars(spark, sf)
    late = c("available_at") > _at(CUTOFF)
    poisoned = bars.select(*[
        F.when(late, c(n) * 1000).otherwise(c(n)).cast("decimal(24,8)").alias(n) if n in ("open", "high", "low", "close") else c(n)
        for n in bars.columns
    ])
    views = [P.split_adjusted_view(b, A.actions(spark), A.sessions(spark, sf), _at(CUTOFF)) for b in (bars, poisoned)]
    return rows_differ(*views).agg(F.count(F.lit(1)).alias("differing_rows"))


@query(f"""WITH {MARKET_BARS}
SELECT symbol, CAST(session AS VARCHAR) AS session, sha256('{{"available_at":"' || {text_of('available_at')} || '","session":"'
  || CAST(session AS VARCHAR) || '","symbol":"' || symbol || '","volume":' || CAST(volume AS VARCHAR) || '}}') AS record_id
FROM market_bars""")
def record_identity(spark, sf):
    from ..functions.identity import canonical_fields, record_id

    bars = A.market_bars(spark, sf)
    fields = canonical_fields(bars, ["symbol", "session", "available_at", "volume"])
    return bars.select("symbol", "session", record_id(fields).alias("record_id"))


@query("SELECT doc_id, sha256(text) AS content_sha256, length(text) = n_chars AS length_matches FROM documents")
def doc_hashes(spark, sf):
    docs = spread(driver_table(spark, sf, "documents"))
    return docs.select(
        "doc_id", sha256(c("text")).alias("content_sha256"), (F.length("text") == c("n_chars")).alias("length_matches")
    )

"""Checks on data in which every fault they look for occurs, and the identity of a whole dataset."""

from __future__ import annotations

from dataclasses import replace
from datetime import date

from pyspark.sql import functions as F

from ..operators import pointintime as P
from ..operators import quality as Q
from ..operators import versions as V
from ..sources import adapters as A
from .market import ACTIONS, DECLARED_BARS, MARKET_BARS, SESSIONS, text_of
from .registry import query

c = F.col

#: A synthetic dataset that may hold no bar without volume and is to be executed from a Saturday on.
PLAN = replace(A.PLAN, origin="synthetic", first_execution_session=date(2024, 1, 6), zero_volume_policy="reject", limitations=("unknown_revision_timing", "synthetic_data"))
CODES = ("bar_order_or_duplicate", "action_order_or_duplicate", "execution_not_session", "zero_volume", "synthetic_data", "bar_provenance")


# Bars of every tenth day come twice, those of days that end in seven have no volume; splits are announced twice.
@query(f"""WITH {DECLARED_BARS}, {ACTIONS},
doubled AS (SELECT symbol, session, feed, CASE WHEN day(session) % 10 = 7 THEN 0 ELSE volume END AS volume FROM declared_bars
  UNION ALL SELECT symbol, session, feed, volume FROM declared_bars WHERE day(session) % 10 = 0)
SELECT 'error' AS severity, 'zero_volume' AS code, symbol, CAST(session AS VARCHAR) AS session FROM doubled WHERE volume = 0
UNION ALL SELECT 'error', 'bar_provenance', symbol, CAST(session AS VARCHAR) FROM doubled WHERE feed <> 'main'
UNION ALL SELECT DISTINCT 'error', 'bar_order_or_duplicate', NULL, NULL FROM (SELECT symbol, session FROM doubled GROUP BY 1, 2 HAVING count(*) > 1)
UNION ALL SELECT DISTINCT 'error', 'action_order_or_duplicate', NULL, NULL FROM actions WHERE kind = 'split'
UNION ALL SELECT 'error', 'execution_not_session', NULL, NULL FROM (SELECT 1) WHERE DATE '2024-01-06' NOT IN (SELECT session FROM sessions)
UNION ALL SELECT 'warning', 'synthetic_data', NULL, NULL""")
def fault_findings(spark, sf):
    bars = A.declared_bars(spark, sf).withColumn("origin", F.lit("synthetic"))
    silent = bars.withColumn("volume", F.when(F.dayofmonth("session") % 10 == 7, F.lit(0).cast("bigint")).otherwise(c("volume")))
    doubled = silent.unionByName(bars.where(F.dayofmonth("session") % 10 == 0))
    actions = A.actions(spark)
    found = Q.quality_findings(PLAN, A.universe(spark), doubled, actions.unionByName(actions.where("kind = 'split'")), A.sessions(spark, sf))
    return found.where(c("code").isin(*CODES))


CUTOFF = "2024-01-23 00:00:00"


# Splits of CLICK are announced three days after their session.
@query(f"""WITH {SESSIONS}, {ACTIONS}
SELECT action_id, a.symbol, CAST(day AS VARCHAR) AS effective_session,
  {text_of("CAST(day AS TIMESTAMP) + INTERVAL 870 MINUTE + CASE WHEN a.symbol = 'CLICK' THEN INTERVAL 3 DAY ELSE INTERVAL 0 DAY END")} AS available_at
FROM actions a JOIN sessions s ON s.session = a.day
WHERE kind = 'split' AND s.market_open <= TIMESTAMP '{CUTOFF}'
  AND CAST(day AS TIMESTAMP) + INTERVAL 870 MINUTE + CASE WHEN a.symbol = 'CLICK' THEN INTERVAL 3 DAY ELSE INTERVAL 0 DAY END > TIMESTAMP '{CUTOFF}'""")
def late_splits(spark, sf):
    cutoff = F.lit(CUTOFF).cast("timestamp")
    announced = F.when(c("symbol") == "CLICK", c("available_at") + F.expr("INTERVAL 3 DAYS")).otherwise(c("available_at"))
    splits = P.effective_splits(A.actions(spark).withColumn("available_at", announced), A.sessions(spark, sf), cutoff)
    return P.late_splits(splits, cutoff).select("action_id", "symbol", "effective_session", "available_at")


def _number(column: str) -> str:
    return f"'\"' || regexp_replace(regexp_replace(CAST({column} AS VARCHAR), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') || '\"'"


def _text(column: str) -> str:
    return f"coalesce('\"' || {column} || '\"', 'null')"


_WORDS = ", ".join(f"CAST(sum(CAST('0x' || substr(d, {1 + 4 * i}, 4) AS INTEGER)) AS BIGINT) AS w{i}" for i in range(16))
_SUMS = ", ".join(f"w{i}" for i in range(16))
#: The plan as one text: fields in order, no spaces.
RECORD = ('{"corporate_actions_coverage":"unknown","coverage_end":"2024-01-30","coverage_start":"2024-01-02","feed":"main","first_execution_session":"2024-01-04",'
          '"limitations":["unknown_revision_timing"],"origin":"historical","provider":"events","retrieved_at":"2024-01-28T00:00:00","revision_policy":"unknown",'
          '"warmup_sessions":3,"zero_volume_policy":"allow_with_warning"}')


@query(f"""WITH {MARKET_BARS}, {ACTIONS},
rows AS (
  SELECT 'bars' AS name, '{{"available_at":"' || {text_of('available_at')} || '","close":' || {_number('close')} || ',"first_ingested_at":"' || {text_of('first_ingested_at')}
    || '","high":' || {_number('high')} || ',"interval_end":"' || {text_of('interval_end')} || '","interval_start":"' || {text_of('interval_start')}
    || '","low":' || {_number('low')} || ',"open":' || {_number('open')} || ',"session":"' || session || '","symbol":"' || symbol || '","volume":' || volume || '}}' AS line FROM market_bars
  UNION ALL SELECT 'actions', '{{"action_id":"' || action_id || '","available_at":"' || {text_of('CAST(day AS TIMESTAMP) + INTERVAL 870 MINUTE')}
    || '","cash_amount_usd":' || coalesce('"' || CAST(CAST(amount AS DOUBLE) AS VARCHAR) || '"', 'null') || ',"effective_session":"' || day || '","first_ingested_at":"'
    || {text_of('CAST(day AS TIMESTAMP) + INTERVAL 870 MINUTE + to_days(delay)')} || '","kind":"' || kind || '","pay_date":' || {_text('CAST(pay_date AS VARCHAR)')}
    || ',"split_ratio":' || coalesce(CAST(ratio AS VARCHAR), 'null') || ',"symbol":"' || symbol || '"}}' FROM actions),
words AS (SELECT name, count(*) AS n, {_WORDS} FROM (SELECT name, sha256(line) AS d FROM rows) GROUP BY name),
tables AS (SELECT name, n, sha256(concat_ws('|', n, {_SUMS})) AS digest FROM words)
SELECT sha256('{RECORD}' || '|' || string_agg(name || ':' || n || ':' || digest, '|' ORDER BY name)) AS dataset_id, CAST(sum(n) AS BIGINT) AS "rows" FROM tables""")
def market_dataset_identity(spark, sf):
    """All columns of all rows of both tables, and the plan."""
    return V.dataset_identity({"bars": A.market_bars(spark, sf), "actions": A.actions(spark)}, V.plan_record(A.PLAN))

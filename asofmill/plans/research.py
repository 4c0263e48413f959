"""Eligibility of decision contexts and consistency of experiments. An order stands for a decision, its line items for
the observations and features attached to it, a customer for an experiment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rules import first_reason, has_duplicates, violations
from ..operators import context as X
from ..operators import experiments as E
from ..operators import records
from ..operators.calendars import is_listed, warmup_start
from ..sources import adapters as A
from ..sources.tables import driver_table, spread
from .registry import query

c = F.col


def _days(column, n):
    return column + F.make_dt_interval(n if not isinstance(n, int) else F.lit(n))


# ---- contexts --------------------------------------------------------------------------------------------------
CTX = """ctx AS (SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN 'backtest' WHEN 'O' THEN 'paper' ELSE 'shadow' END AS mode,
    o_orderdate + INTERVAL 60 DAY + INTERVAL 22 HOUR AS decision, o_orderdate + INTERVAL 61 DAY + INTERVAL 15 HOUR AS execution,
    CAST(o_orderdate AS DATE) + 61 + CASE WHEN o_orderkey % 23 = 0 THEN 1 ELSE 0 END AS exec_session FROM orders),
obs AS (SELECT l_orderkey AS k, 'S' || CAST(l_partkey % 7 AS VARCHAR) AS symbol, CAST(l_shipdate AS DATE) AS session,
    l_suppkey % 4 AS ds, l_shipdate + INTERVAL 22 HOUR AS available, l_shipdate + INTERVAL 22 HOUR + to_days(l_linenumber) AS ingested,
    CASE WHEN l_returnflag = 'N' THEN 'synthetic' ELSE 'historical' END AS origin, l_linenumber, l_tax, l_discount, l_partkey FROM lineitem),
feat AS (SELECT *, available + to_hours(l_linenumber - 3) AS f_available, available + to_days(l_linenumber - 1) AS computed,
    available + to_days(CAST(l_partkey % 5 AS INTEGER)) AS adjusted, CASE WHEN l_partkey % 29 = 0 THEN 's2' ELSE 's1' END AS schema_id,
    CASE WHEN l_partkey % 31 = 0 THEN ['b', 'a'] ELSE ['a', 'b'] END AS names,
    CASE WHEN l_partkey % 37 = 0 THEN session + 1 ELSE session END AS f_session FROM obs WHERE l_tax > 0.04),
raw AS (SELECT k, symbol, session, ds, min(available) AS available, min(ingested) AS ingested FROM obs GROUP BY ALL),
docs AS (SELECT k, l_partkey AS doc, ds, available, ingested FROM obs WHERE l_discount > 0.07),
macro AS (SELECT o_orderkey AS k, o_custkey % 4 AS ds, o_orderdate + to_days(CAST(o_custkey % 90 AS INTEGER)) AS cutoff,
    CASE WHEN o_custkey % 2 = 0 THEN 'prospective' ELSE 'historical_exploratory' END AS use FROM orders WHERE o_orderkey % 4 = 0)"""

VIOLATIONS = """v AS (
  SELECT k, 'execution_date' AS reason FROM ctx WHERE CAST(execution - INTERVAL 5 HOUR AS DATE) <> exec_session
  UNION ALL SELECT k, 'portfolio_after_decision' FROM ctx WHERE k % 19 = 0
  UNION ALL SELECT o.k, 'undeclared' FROM obs o JOIN ctx USING (k) WHERE symbol IN ('S5', 'S6') OR ds = 3
  UNION ALL SELECT o.k, 'not_yet_available' FROM obs o JOIN ctx USING (k) WHERE available > decision OR session >= exec_session
  UNION ALL SELECT o.k, 'ingested_after_decision' FROM obs o JOIN ctx USING (k) WHERE mode <> 'backtest' AND ingested > decision
  UNION ALL SELECT o.k, 'synthetic_outside_backtest' FROM obs o JOIN ctx USING (k) WHERE mode <> 'backtest' AND origin = 'synthetic'
  UNION ALL SELECT k, 'execution_outside_listing' FROM ctx WHERE exec_session >= DATE '2000-01-01'
  UNION ALL SELECT k, 'duplicate_observation' FROM (SELECT k FROM obs GROUP BY k, symbol, session HAVING count(*) > 1)
  UNION ALL SELECT f.k, 'undeclared' FROM feat f JOIN ctx USING (k) WHERE symbol IN ('S5', 'S6') OR ds = 3
  UNION ALL SELECT f.k, 'not_yet_available' FROM feat f JOIN ctx USING (k) WHERE f_available > decision OR f_session >= exec_session
  UNION ALL SELECT f.k, 'adjusted_after_decision' FROM feat f JOIN ctx USING (k) WHERE adjusted > decision
  UNION ALL SELECT f.k, 'computed_after_decision' FROM feat f JOIN ctx USING (k) WHERE mode <> 'backtest' AND computed > decision
  UNION ALL SELECT f.k, 'feature_schema' FROM feat f JOIN ctx USING (k) WHERE schema_id <> 's1'
  UNION ALL SELECT f.k, 'feature_names' FROM feat f JOIN ctx USING (k) WHERE names <> ['a', 'b']
  UNION ALL SELECT f.k, 'no_observation' FROM feat f JOIN ctx USING (k) LEFT JOIN raw r ON r.k = f.k AND r.symbol = f.symbol AND r.session = f.f_session AND r.ds = f.ds
    WHERE r.k IS NULL OR f.f_available < r.available
  UNION ALL SELECT f.k, 'computed_before_ingestion' FROM feat f JOIN ctx USING (k) JOIN raw r ON r.k = f.k AND r.symbol = f.symbol AND r.session = f.f_session AND r.ds = f.ds
    WHERE f.computed < r.ingested
  UNION ALL SELECT k, 'duplicate_feature' FROM (SELECT k FROM feat GROUP BY k, symbol, f_session HAVING count(*) > 1)
  UNION ALL SELECT d.k, 'document_not_eligible' FROM docs d JOIN ctx USING (k) WHERE ds = 3 OR available > decision
  UNION ALL SELECT d.k, 'document_ingested_after_decision' FROM docs d JOIN ctx USING (k) WHERE mode <> 'backtest' AND ingested > decision
  UNION ALL SELECT k, 'duplicate_document' FROM (SELECT k FROM docs GROUP BY k, doc HAVING count(*) > 1)
  UNION ALL SELECT k, 'macro_undeclared' FROM macro WHERE ds = 3
  UNION ALL SELECT m.k, 'macro_future_or_expired' FROM macro m JOIN ctx USING (k) WHERE NOT (cutoff <= decision AND decision < cutoff + INTERVAL 45 DAY)
  UNION ALL SELECT m.k, 'macro_not_prospective' FROM macro m JOIN ctx USING (k) WHERE mode <> 'backtest' AND (use <> 'prospective' OR cutoff + INTERVAL 1 DAY > decision)
  UNION ALL SELECT m.k, 'macro_not_exploratory' FROM macro m JOIN ctx USING (k) WHERE mode = 'backtest' AND use <> 'historical_exploratory')"""


def _contexts(spark, sf):
    key = c("o_orderkey")
    at = c("o_orderdate").cast("timestamp")
    decision = at + F.expr("INTERVAL '60 22' DAY TO HOUR")
    return driver_table(spark, sf, "orders").select(
        key.alias("context_id"),
        F.when(c("o_orderstatus") == "F", "backtest").when(c("o_orderstatus") == "O", "paper").otherwise("shadow").alias("mode"),
        decision.alias("decision_at"), (at + F.expr("INTERVAL '61 15' DAY TO HOUR")).alias("execution_at"),
        F.date_add(F.to_date("o_orderdate"), F.when(key % 23 == 0, 62).otherwise(61)).alias("execution_session"),
        (at + F.expr("INTERVAL 65 DAYS")).alias("target_expires_at"),
        F.when(key % 19 == 0, decision + F.expr("INTERVAL 1 HOURS")).otherwise(decision).alias("portfolio_as_of"),
        F.array(*[F.lit(n).cast("bigint") for n in (0, 1, 2)]).alias("dataset_ids"), F.lit("s1").alias("feature_schema_id"),
        F.array(F.lit("a"), F.lit("b")).alias("feature_names"), F.lit(None).cast("timestamp").alias("model_trained_through"),
        F.lit(None).cast("timestamp").alias("model_created_at"),
    )


def _observations(spark, sf):
    at = c("l_shipdate").cast("timestamp") + F.expr("INTERVAL 22 HOURS")
    return spread(driver_table(spark, sf, "lineitem")).select(
        c("l_orderkey").alias("context_id"), F.concat(F.lit("S"), (c("l_partkey") % 7).cast("string")).alias("symbol"),
        F.to_date("l_shipdate").alias("session"), (c("l_suppkey") % 4).alias("dataset_id"), at.alias("available_at"),
        _days(at, c("l_linenumber")).alias("first_ingested_at"),
        F.when(c("l_returnflag") == "N", "synthetic").otherwise("historical").alias("origin"), "l_linenumber", "l_tax", "l_discount",
        "l_partkey",
    )


def _features(spark, sf):
    at = c("available_at")
    hours = F.make_dt_interval(F.lit(0), c("l_linenumber") - 3)
    return _observations(spark, sf).where(c("l_tax") > 0.04).select(
        "context_id", "symbol", F.when(c("l_partkey") % 37 == 0, F.date_add("session", 1)).otherwise(c("session")).alias("session"),
        "dataset_id", (at + hours).alias("available_at"), _days(at, c("l_linenumber") - 1).alias("computed_at"),
        _days(at, (c("l_partkey") % 5).cast("int")).alias("adjusted_as_of"),
        F.when(c("l_partkey") % 29 == 0, "s2").otherwise("s1").alias("feature_schema_id"),
        F.when(c("l_partkey") % 31 == 0, F.array(F.lit("b"), F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b"))).alias("names"),
    )


@query(f"WITH {CTX}, {VIOLATIONS} SELECT k AS context_id, reason, count(*) AS findings FROM v GROUP BY k, reason")
def eligible_context(spark, sf):
    contexts = _contexts(spark, sf)
    observations = _observations(spark, sf)
    features = _features(spark, sf)
    documents = observations.where(c("l_discount") > 0.07).select(
        "context_id", c("l_partkey").alias("document_id"), "dataset_id", "available_at", "first_ingested_at"
    )
    listed = F.explode(F.array(*[F.lit(f"S{n}") for n in range(5)])).alias("symbol")
    universe = contexts.select("context_id", listed).select(
        "*", F.lit("1990-01-01").cast("date").alias("listed_on"),
        F.when(c("symbol") == "S4", F.lit("2000-01-01").cast("date")).alias("delisted_on"),
    )
    cutoff = _days(c("o_orderdate").cast("timestamp"), (c("o_custkey") % 90).cast("int"))
    macro = driver_table(spark, sf, "orders").where(c("o_orderkey") % 4 == 0).select(
        c("o_orderkey").alias("context_id"), c("o_orderkey").alias("assessment_id"), (c("o_custkey") % 4).alias("dataset_id"),
        cutoff.alias("source_cutoff"), _days(cutoff, 45).alias("expires_at"), _days(cutoff, 1).alias("generated_at"),
        F.when(c("o_custkey") % 2 == 0, "prospective").otherwise("historical_exploratory").alias("use"),
    )
    report = X.eligible_context(contexts, universe, observations, features, documents, macro)
    return report.groupBy("context_id", "reason").agg(F.count(F.lit(1)).alias("findings"))


@query("""SELECT c_custkey, c_custkey % 30 + 1 <= 20 AND c_custkey % 30 + 1 >= c_custkey % 12 + 1 AS listed FROM customer""")
def listing_membership(spark, sf):
    key = c("c_custkey")
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))
    listed = is_listed(day(key % 30), day(key % 12), F.lit("2024-01-21").cast("date"))
    return driver_table(spark, sf, "customer").select(key, listed.alias("listed"))


# ---- experiments -----------------------------------------------------------------------------------------------
EXP = """e AS (SELECT c_custkey AS k, CASE c_nationkey % 3 WHEN 0 THEN 'synthetic' WHEN 1 THEN 'historical_exploratory' ELSE 'prospective' END AS use,
    CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'paper' ELSE 'backtest' END AS mode, c_custkey % 6 = 0 AS lm,
    CASE WHEN c_custkey % 2 = 0 THEN ['t0', 't1'] ELSE ['t0', 't1', 't2'] END AS tags FROM customer),
d AS (SELECT o_custkey AS k, o_orderkey % 500 AS dataset_id, CASE o_orderstatus WHEN 'F' THEN 'market' WHEN 'O' THEN 'documents' ELSE 'macro_assessments' END AS kind,
    CASE WHEN o_orderpriority = '1-URGENT' THEN 'synthetic' ELSE 'historical' END AS origin,
    list_transform(range(o_orderkey % 4), lambda x: 't' || CAST(x AS VARCHAR)) AS tags FROM orders),
f AS (SELECT k, list_sort(list(DISTINCT kind)) AS kinds, bool_or(origin = 'synthetic') AS syn, count(*) AS n, count(DISTINCT dataset_id) AS ids FROM d GROUP BY k)"""


def _experiments(spark, sf):
    key = c("c_custkey")
    tags = lambda n: F.array(*[F.lit(f"t{i}") for i in range(n)])
    return driver_table(spark, sf, "customer").select(
        key.alias("experiment_id"),
        F.when(c("c_nationkey") % 3 == 0, "synthetic").when(c("c_nationkey") % 3 == 1, "historical_exploratory")
        .otherwise("prospective").alias("research_use"),
        F.when(c("c_mktsegment").isin("BUILDING", "MACHINERY"), "paper").otherwise("backtest").alias("mode"),
        (key % 6 == 0).alias("has_language_model"), F.when(key % 2 == 0, tags(2)).otherwise(tags(3)).alias("limitations"),
        F.lit("2024-01-02").cast("date").alias("start_session"), F.lit("2024-01-30").cast("date").alias("end_session"),
        F.when(key % 25 == 0, F.lit("2024-01-10").cast("timestamp")).alias("model_trained_through"),
    )


def _datasets(spark, sf):
    key = c("o_orderkey")
    tags = F.slice(F.array(*[F.lit(f"t{i}") for i in range(3)]), F.lit(1), (key % 4).cast("int"))
    return driver_table(spark, sf, "orders").select(
        c("o_custkey").alias("experiment_id"), (key % 500).alias("dataset_id"),
        F.when(c("o_orderstatus") == "F", "market").when(c("o_orderstatus") == "O", "documents").otherwise("macro_assessments").alias("kind"),
        F.when(c("o_orderpriority") == "1-URGENT", "synthetic").otherwise("historical").alias("origin"), tags.alias("limitations"),
    )


@query(f"""WITH {EXP}
SELECT d.k AS experiment_id, dataset_id, count(*) AS gaps FROM d JOIN e ON e.k = d.k
WHERE len(list_filter(d.tags, lambda x: NOT list_contains(e.tags, x))) > 0 GROUP BY d.k, dataset_id""")
def limitation_subset(spark, sf):
    gaps = E.limitation_gaps(_datasets(spark, sf), _experiments(spark, sf))
    return gaps.groupBy("experiment_id", "dataset_id").agg(F.count(F.lit(1)).alias("gaps"))


@query(f"""WITH {EXP} SELECT k AS experiment_id, array_to_string(kinds, ',') AS kinds, syn AS any_synthetic, n AS declared, ids AS distinct_ids FROM f""")
def dataset_facts(spark, sf):
    return E.dataset_facts(_datasets(spark, sf))


@query(f"""WITH {EXP}, j AS (SELECT e.*, coalesce(f.kinds, []) AS kinds, coalesce(syn, false) AS syn, n, ids FROM e LEFT JOIN f ON f.k = e.k),
r AS (SELECT k, unnest([
    CASE WHEN n <> ids THEN 'duplicate_dataset' END, CASE WHEN NOT list_contains(kinds, 'market') THEN 'no_market_dataset' END,
    CASE WHEN lm AND NOT (list_contains(kinds, 'documents') AND list_contains(kinds, 'macro_assessments')) THEN 'language_model_datasets' END,
    CASE WHEN list_contains(kinds, 'macro_assessments') AND NOT lm THEN 'assessments_without_model' END,
    CASE WHEN mode = 'backtest' AND use = 'prospective' THEN 'backtest_prospective' END,
    CASE WHEN mode <> 'backtest' AND use <> 'prospective' THEN 'live_not_prospective' END,
    CASE WHEN syn <> (use = 'synthetic') THEN 'synthetic_use' END, CASE WHEN k % 25 = 0 THEN 'model_cutoff' END]) AS reason FROM j
  UNION ALL SELECT d.k, 'limitations_not_declared' FROM d JOIN e ON e.k = d.k WHERE len(list_filter(d.tags, lambda x: NOT list_contains(e.tags, x))) > 0)
SELECT DISTINCT k AS experiment_id, reason FROM r WHERE reason IS NOT NULL""")
def experiment_checks(spark, sf):
    return E.experiment_violations(_experiments(spark, sf), _datasets(spark, sf))


@query("""WITH c AS (SELECT o_orderkey AS k, o_custkey AS e, o_orderkey % 9 = 0 AS bad_run, o_orderstatus, o_orderdate,
    CASE WHEN o_orderkey % 8 = 0 THEN [1, 2] ELSE [2, 1, 0] END AS ids FROM orders)
SELECT DISTINCT k AS context_id, reason FROM (
  SELECT k, unnest([CASE WHEN bad_run THEN 'different_run' END, CASE WHEN o_orderstatus <> 'F' THEN 'different_mode' END,
    CASE WHEN NOT (CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '2000-12-31') THEN 'outside_range' END,
    CASE WHEN len(ids) < 3 THEN 'dataset_ids' END]) AS reason FROM c
  UNION ALL SELECT l_orderkey, 'observation_provenance' FROM lineitem JOIN c ON k = l_orderkey
    WHERE l_suppkey % 4 = 3 OR l_returnflag = 'N' OR l_suppkey % 4 = 1
  UNION ALL SELECT l_orderkey, 'document_provenance' FROM lineitem JOIN c ON k = l_orderkey
    WHERE l_discount > 0.07 AND (l_suppkey % 4 <> 1 OR l_tax > 0.06)) WHERE reason IS NOT NULL""")
def context_binding(spark, sf):
    key = c("o_orderkey")
    ids = lambda *n: F.array(*[F.lit(i).cast("bigint") for i in n])
    contexts = driver_table(spark, sf, "orders").select(
        key.alias("context_id"), c("o_custkey").alias("experiment_id"), F.when(key % 9 == 0, -1).otherwise(c("o_custkey")).alias("run_id"),
        F.when(c("o_orderstatus") == "F", "backtest").otherwise("paper").alias("mode"), F.to_date("o_orderdate").alias("execution_session"),
        F.when(key % 8 == 0, ids(1, 2)).otherwise(ids(2, 1, 0)).alias("dataset_ids"),
    )
    experiments = driver_table(spark, sf, "customer").select(
        c("c_custkey").alias("experiment_id"), c("c_custkey").alias("run_id"), F.lit("backtest").alias("mode"),
        F.lit("1996-01-01").cast("date").alias("start_session"), F.lit("2000-12-31").cast("date").alias("end_session"),
    )
    number = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(2).cast("bigint"))).alias("dataset_id")
    datasets = experiments.select("experiment_id", number).select(
        "*", F.when(c("dataset_id") == 1, "documents").otherwise("market").alias("kind"), F.lit("historical").alias("origin"),
        F.lit("events").alias("provider"), F.lit("main").alias("feed"), F.lit("point_in_time").alias("revision_policy"),
    )
    rows = _observations(spark, sf).select(
        "*", F.lit("events").alias("provider"), F.lit("main").alias("feed"),
        F.when(c("l_tax") > 0.06, "unknown").otherwise("point_in_time").alias("revision_policy"),
    )
    return E.binding_violations(contexts, experiments, datasets, rows, rows.where(c("l_discount") > 0.07))


@query("""SELECT l_orderkey, count(DISTINCT l_partkey) FILTER (WHERE l_linenumber <= 3) AS left_items,
  count(DISTINCT l_partkey) FILTER (WHERE l_linenumber >= 2) AS right_items,
  count(DISTINCT l_partkey) FILTER (WHERE l_linenumber <= 3) = count(DISTINCT l_partkey) AND
  count(DISTINCT l_partkey) FILTER (WHERE l_linenumber >= 2) = count(DISTINCT l_partkey) AS equal
FROM lineitem GROUP BY l_orderkey""")
def set_equality(spark, sf):
    lines = driver_table(spark, sf, "lineitem")
    sides = E.set_equality(
        lines.where(c("l_linenumber") <= 3), lines.where(c("l_linenumber") >= 2), ["l_orderkey"], "l_partkey"
    )
    return sides


@query("""SELECT p_partkey, 'x' AS note FROM part WHERE p_partkey % 12 = 0 OR p_size % 9 = 0""")
def snapshot_instruments(spark, sf):
    part = driver_table(spark, sf, "part").select("p_partkey", "p_brand", "p_size")
    published = part.where(c("p_partkey") % 12 != 0).withColumn(
        "p_size", F.when(c("p_size") % 9 == 0, F.lit(None)).otherwise(c("p_size"))
    )
    return E.instrument_mismatches(part, published, ["p_partkey"]).withColumn("note", F.lit("x"))


@query("""WITH s AS (SELECT DISTINCT CAST(d AS DATE) AS session FROM (
    SELECT unnest(generate_series(min(o_orderdate), max(o_orderdate), INTERVAL 1 DAY)) AS d FROM orders) WHERE isodow(d) < 6),
n AS (SELECT session, row_number() OVER (ORDER BY session) AS pos FROM s),
e AS (SELECT c_custkey AS k, DATE '1995-01-02' + CAST(c_custkey % 12 AS INTEGER) AS st, c_custkey % 8 AS w,
    DATE '1995-01-02' + CAST(c_custkey % 12 + c_custkey % 40 AS INTEGER) AS en, DATE '1995-01-01' + CAST(c_custkey % 9 AS INTEGER) AS listed FROM customer),
x AS (SELECT e.*, (SELECT count(*) FROM s WHERE session < st) AS prior, st IN (SELECT session FROM s) AS known FROM e),
y AS (SELECT x.*, CASE WHEN w > 0 AND prior >= w THEN (SELECT session FROM n WHERE pos = prior - w + 1) ELSE st END AS need FROM x)
SELECT k AS experiment_id, CASE WHEN k % 10 = 0 THEN 'reference' WHEN NOT known OR en > DATE '1995-02-10' OR prior < w THEN 'coverage'
  WHEN listed > need THEN 'warmup_before_listing' END AS reason FROM y""")
def snapshot_binding(spark, sf):
    key = c("c_custkey")
    base = F.lit("1995-01-02").cast("date")
    experiments = driver_table(spark, sf, "customer").select(
        key.alias("experiment_id"), F.date_add(base, (key % 12).cast("int")).alias("first_execution_session"),
        (key % 8).alias("warmup_sessions"), F.date_add(base, (key % 12 + key % 40).cast("int")).alias("end_session"),
        F.date_add(F.lit("1995-01-01").cast("date"), (key % 9).cast("int")).alias("listed_on"),
        F.when(key % 10 == 0, "other").otherwise("same").alias("declared_reference"), F.lit("same").alias("snapshot_reference"),
        F.lit("1995-02-10").cast("date").alias("coverage_end"),
    )
    bound = warmup_start(experiments, A.order_sessions(spark, sf))
    return bound.select("experiment_id", first_reason(E.snapshot_rules()).alias("reason"))


@query("""SELECT c_custkey, unnest(list_filter([CASE WHEN c_custkey % 5 = 0 THEN 'duplicate_feature_name' END,
  CASE WHEN c_custkey % 7 = 0 THEN 'duplicate_parameter' END,
  CASE WHEN c_custkey % 11 = 0 THEN 'training_order' END, CASE WHEN c_custkey % 3 = 0 THEN 'feature_schema' END,
  CASE WHEN c_custkey % 2 = 0 AND c_custkey % 5 <> 0 THEN 'feature_order' WHEN c_custkey % 2 = 0 THEN 'feature_order' END], lambda x: x IS NOT NULL)) AS reason
FROM customer""")
def strategy_checks(spark, sf):
    key = c("c_custkey")
    names = lambda *n: F.array(*[F.lit(i) for i in n])
    at = F.lit("2024-01-01").cast("timestamp")
    own = F.when(key % 5 == 0, names("a", "a")).otherwise(names("a", "b"))
    rows = driver_table(spark, sf, "customer").select(
        key, own.alias("feature_names"), F.when(key % 7 == 0, names("p", "p")).otherwise(names("p", "q")).alias("parameter_names"),
        F.when(key % 11 == 0, at + F.expr("INTERVAL 1 DAYS")).otherwise(at).alias("trained_through"), at.alias("created_at"),
        F.when(key % 3 == 0, "s2").otherwise("s1").alias("model_schema_id"), F.lit("s1").alias("feature_schema_id"),
        F.when(key % 2 == 0, names("b", "a")).otherwise(own).alias("model_feature_names"),
    )
    return violations(rows, ["c_custkey"], records.model_rules())


@query("""SELECT o_orderkey, unnest(list_filter([
  CASE WHEN o_orderkey % 10 = 0 THEN 'clock_order' END,
  CASE WHEN o_orderkey % 3 = 2 THEN 'unknown_kind' END,
  CASE WHEN o_orderkey % 3 = 0 AND (o_orderkey % 4 = 0 OR o_orderkey % 6 < 2) THEN 'split_fields' END,
  CASE WHEN o_orderkey % 3 = 1 AND o_orderkey % 8 = 0 THEN 'dividend_fields' END], lambda x: x IS NOT NULL)) AS reason FROM orders""")
def action_constraints(spark, sf):
    key = c("o_orderkey")
    at = c("o_orderdate").cast("timestamp")
    split, dividend = key % 3 == 0, key % 3 == 1
    rows = driver_table(spark, sf, "orders").select(
        key, F.when(split, "split").when(dividend, "cash_dividend").otherwise("merger").alias("kind"), at.alias("available_at"),
        F.when(key % 10 == 0, at - F.expr("INTERVAL 1 DAYS")).otherwise(at).alias("first_ingested_at"),
        F.when(split, key % 6).alias("split_ratio"), F.to_date("o_orderdate").alias("effective_session"),
        F.when(dividend | (key % 4 == 0), F.lit("0.5").cast("decimal(24,8)")).alias("cash_amount_usd"),
        F.when(dividend, F.date_add(F.to_date("o_orderdate"), F.when(key % 8 == 0, -1).otherwise(5))).alias("pay_date"),
    )
    return violations(rows, ["o_orderkey"], records.action_rules())


@query("""SELECT c_custkey, has FROM (SELECT c_custkey, len(list_distinct(l)) < len(l) AS has FROM (
  SELECT c_custkey, [c_nationkey, c_custkey % 25, c_custkey % 5] AS l FROM customer))""")
def unique_names(spark, sf):
    names = F.array(c("c_nationkey").cast("bigint"), c("c_custkey") % 25, c("c_custkey") % 5)
    return driver_table(spark, sf, "customer").select("c_custkey", has_duplicates(names).alias("has"))


@query("""SELECT source, 'bar' AS kind, count(*) AS n FROM (SELECT event_type AS source FROM events) GROUP BY 1
UNION ALL SELECT o_orderstatus, 'feature', count(*) FROM orders GROUP BY 1""")
def heterogeneous_rows(spark, sf):
    bars = driver_table(spark, sf, "events").select(c("event_type").alias("source"), F.lit("bar").alias("kind"), c("ts").alias("at"))
    features = driver_table(spark, sf, "orders").select(c("o_orderstatus").alias("source"), F.lit("feature").alias("kind"), "o_totalprice")
    both = bars.unionByName(features, allowMissingColumns=True)
    return both.groupBy("source", "kind").agg(F.count(F.lit(1)).alias("n"))


# ---- record constraints ----------------------------------------------------------------------------------------
def _reasons(*cases: str) -> str:
    return "unnest(list_filter([" + ", ".join(cases) + "], lambda x: x IS NOT NULL)) AS reason"


@query("SELECT o_orderkey, " + _reasons(
    "CASE WHEN o_orderkey % 4 = 3 OR o_orderkey % 5 = 0 THEN 'schema_for_kind' END",
    "CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN 'revision_limitation' END") + " FROM orders")
def dataset_reference_checks(spark, sf):
    key = c("o_orderkey")
    kind = F.when(key % 4 == 0, "market").when(key % 4 == 1, "documents").when(key % 4 == 2, "macro_assessments").otherwise("other")
    schema = (
        F.when(key % 5 == 0, "unknown.v1").when(key % 4 == 0, "market_observation.v1").when(key % 4 == 1, "source_document.v1")
        .otherwise("macro_assessment.v1")
    )
    tags = F.when(key % 2 == 0, F.array(F.lit("other"))).otherwise(F.array(F.lit("unknown_revision_timing")))
    rows = driver_table(spark, sf, "orders").select(
        key, kind.alias("kind"), schema.alias("schema_id"), tags.alias("limitations"),
        F.when(key % 3 == 0, "unknown").otherwise("point_in_time").alias("revision_policy"),
    )
    return violations(rows, ["o_orderkey"], records.dataset_rules())


@query("SELECT c_custkey, " + _reasons(
    "CASE WHEN c_custkey % 9 = 0 THEN 'duplicate_limitations' END", "CASE WHEN c_custkey % 7 > 4 THEN 'date_order' END",
    "CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 <> 0 THEN 'revision_limitation' END",
    "CASE WHEN (c_custkey % 5 = 0) <> (c_custkey % 4 = 0) THEN 'synthetic_limitation' END") + " FROM customer")
def plan_checks(spark, sf):
    key = c("c_custkey")
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n)
    tags = F.array_compact(F.array(
        F.lit("fixed_declared_universe"), F.when(key % 9 == 0, F.lit("fixed_declared_universe")),
        F.when(key % 3 == 0, F.lit("unknown_revision_timing")), F.when(key % 4 == 0, F.lit("synthetic_data")),
    ))
    rows = driver_table(spark, sf, "customer").select(
        key, tags.alias("limitations"), day(F.lit(0)).alias("coverage_start"), day(F.lit(4)).alias("coverage_end"),
        day((key % 7).cast("int")).alias("first_execution_session"),
        F.when(key % 2 == 0, "unknown").otherwise("point_in_time").alias("revision_policy"),
        F.when(key % 5 == 0, "synthetic").otherwise("historical").alias("origin"),
    )
    return violations(rows, ["c_custkey"], records.plan_rules())


@query("SELECT l_orderkey, l_linenumber, l_partkey, " + _reasons(
    "CASE WHEN l_partkey % 6 = 0 THEN 'duplicate_feature_name' END", "CASE WHEN l_linenumber = 1 OR l_partkey % 11 = 0 THEN 'clock_order' END",
    "CASE WHEN l_partkey % 8 = 0 THEN 'session_after_availability' END") + " FROM lineitem")
def feature_constraints(spark, sf):
    # Noon in UTC falls on the same date in New York, whatever the season.
    noon = c("l_shipdate").cast("timestamp") + F.expr("INTERVAL 17 HOURS")
    named = lambda n: F.struct(F.lit(n).alias("name"), c("l_tax").cast("decimal(24,8)").alias("value"))
    values = F.when(c("l_partkey") % 6 == 0, F.array(named("a"), named("a"))).otherwise(F.array(named("a"), named("b")))
    rows = driver_table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", values.alias("values"), noon.alias("available_at"),
        _days(noon, c("l_linenumber") - 2).alias("computed_at"),
        F.when(c("l_partkey") % 11 == 0, _days(noon, 30)).otherwise(_days(noon, -2)).alias("adjusted_as_of"),
        F.date_add(F.to_date("l_shipdate"), F.when(c("l_partkey") % 8 == 0, 1).otherwise(0)).alias("session"),
    )
    return violations(rows, ["l_orderkey", "l_linenumber", "l_partkey"], records.feature_rules())


@query("SELECT c_custkey, " + _reasons(
    "CASE WHEN c_custkey % 3 = 0 THEN 'file_list' END", "CASE WHEN c_custkey % 4 = 0 OR c_custkey % 5 = 0 THEN 'quality' END",
    "CASE WHEN c_custkey % 7 = 0 THEN 'identity' END") + " FROM customer")
def manifest_checks(spark, sf):
    key = c("c_custkey")
    names = lambda *n: F.array(*[F.lit(i) for i in n])
    rows = driver_table(spark, sf, "customer").select(
        key, F.when(key % 3 == 0, names("actions.parquet", "bars.parquet", "sessions.parquet"))
        .otherwise(names("bars.parquet", "actions.parquet", "sessions.parquet")).alias("file_names"),
        (key % 4 != 0).alias("usable"), F.lit("historical").alias("origin"),
        F.when(key % 5 == 0, "synthetic").otherwise("historical").alias("quality_origin"),
        c("c_name").alias("dataset_id"), F.when(key % 7 == 0, F.lit("x")).otherwise(c("c_name")).alias("content_sha256"),
    )
    return violations(rows, ["c_custkey"], records.manifest_rules())


@query("""SELECT o_orderkey, 'date_order' AS reason FROM orders
WHERE NOT (o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderkey % 6 <= 3)""")
def request_constraints(spark, sf):
    day = F.to_date("o_orderdate")
    rows = driver_table(spark, sf, "orders").select(
        "o_orderkey", day.alias("start_session"), F.date_add(day, (c("o_orderkey") % 6).cast("int")).alias("first_execution_session"),
        F.date_add(day, 3).alias("end_session"),
    )
    return violations(rows, ["o_orderkey"], records.request_rules("1996-01-01"))

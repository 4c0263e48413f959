"""Lifecycle reports over events read as job events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rules import first_reason
from ..operators import lifecycle as J
from ..sources import adapters as A
from ..sources.tables import driver_table
from .registry import query

c = F.col

STATE = """CASE event_type WHEN 'signup' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'succeeded'
  WHEN 'error' THEN 'failed' WHEN 'view' THEN 'cancelled' END"""
AT = "strftime({}, '%Y-%m-%dT%H:%M:%S.%fZ')"
JOBS = f"""jobs AS (SELECT event_id AS request_id, ts AS created_at, {STATE} AS state,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) % 2 = 0 AS cancelled FROM events)"""
JOB_EVENTS = f"job_events AS (SELECT user_id AS request_id, event_id AS sequence, ts AS happened_at, {STATE} AS state FROM events)"


@query(f"WITH {JOBS} SELECT state, count(*) AS jobs FROM jobs GROUP BY state")
def state_counts(spark, sf):
    return J.state_counts(A.jobs(spark, sf))


@query("WITH " + JOBS + " SELECT " + ", ".join(f"count(*) FILTER (WHERE state = '{s}') AS {s}" for s in J.STATES) + " FROM jobs")
def state_pivot(spark, sf):
    return J.state_pivot(A.jobs(spark, sf))


@query(f"""WITH {JOBS} SELECT request_id, {AT.format('created_at')} AS created_at, state, cancelled AS cancellation_requested
FROM jobs ORDER BY jobs.created_at DESC, request_id DESC LIMIT 100""")
def recent_jobs(spark, sf):
    return J.recent_jobs(A.jobs(spark, sf), 100)


@query(f"""WITH {JOBS} SELECT request_id, {AT.format('created_at')} AS created_at FROM jobs WHERE state = 'queued' AND NOT cancelled""")
def claimable_jobs(spark, sf):
    return J.claimable(A.jobs(spark, sf)).select("request_id", "created_at")


@query(f"""WITH {JOBS} SELECT request_id, state FROM jobs WHERE state = 'queued' AND NOT cancelled ORDER BY created_at, request_id LIMIT 1""")
def next_claimable_job(spark, sf):
    return J.next_claimable(A.jobs(spark, sf)).select("request_id", "state")


@query(f"""WITH {JOB_EVENTS} SELECT request_id, arg_max(state, sequence) AS state, {AT.format('min(happened_at)')} AS created_at,
  {AT.format('max(happened_at)')} AS updated_at, count(*) AS events FROM job_events GROUP BY request_id""")
def latest_states(spark, sf):
    return J.latest_states(A.job_events(spark, sf))


@query(f"""WITH {JOB_EVENTS}, l AS (SELECT request_id, arg_max(state, sequence) AS latest FROM job_events GROUP BY 1)
SELECT request_id, latest, sequence, {AT.format('happened_at')} AS "at", state AS event_state FROM job_events JOIN l USING (request_id)""")
def job_history(spark, sf):
    events = A.job_events(spark, sf)
    jobs = J.latest_states(events).select("request_id", c("state").alias("latest"))
    return J.history(jobs, events)


@query(f"""WITH {JOB_EVENTS}, s AS (SELECT *, lag(state) OVER (PARTITION BY request_id ORDER BY sequence) AS previous_state FROM job_events)
SELECT request_id, sequence, previous_state, state FROM s WHERE CASE WHEN previous_state IS NULL THEN state <> 'queued'
  WHEN previous_state = 'queued' THEN state NOT IN ('running', 'cancelled')
  WHEN previous_state = 'running' THEN state = 'queued' ELSE true END""")
def illegal_transitions(spark, sf):
    steps = J.illegal_transitions(A.job_events(spark, sf), F.to_date("at"))
    return steps.select("request_id", "sequence", "previous_state", "state")


@query("""SELECT event_id % 3000 AS request_id, count(*) AS submissions FROM events GROUP BY 1
HAVING count(DISTINCT CAST(user_id % 3 AS VARCHAR) || event_type || CAST(length(props) AS VARCHAR)) > 1""")
def resubmission_conflicts(spark, sf):
    requests = driver_table(spark, sf, "events").select(
        (c("event_id") % 3000).alias("request_id"), (c("user_id") % 3).alias("run_id"), c("event_type").alias("kind"),
        F.length("props").alias("payload"),
    )
    return J.resubmission_conflicts(requests)


@query(f"""WITH {JOB_EVENTS} SELECT request_id FROM job_events WHERE happened_at <= TIMESTAMP '2024-01-20'
GROUP BY request_id HAVING arg_max(state, sequence) = 'running'""")
def orphaned_jobs(spark, sf):
    return J.orphaned(A.job_events(spark, sf), F.lit("2024-01-20").cast("timestamp")).select("request_id")


@query("""SELECT o_orderkey AS request_id, CASE WHEN o_orderstatus = 'P' AND o_orderkey % 3 = 0 THEN 'unknown_state'
  WHEN o_orderkey % 130 > 100 THEN 'progress_range' WHEN (o_orderkey % 7 = 0) <> (o_orderkey % 5 = 0) THEN 'partial_artifact'
  WHEN o_orderstatus = 'F' AND o_orderkey % 5 <> 0 THEN 'success_without_artifact' END AS reason FROM orders""")
def job_table_checks(spark, sf):
    key = c("o_orderkey")
    state = (
        F.when((c("o_orderstatus") == "P") & (key % 3 == 0), "paused").when(c("o_orderstatus") == "P", "queued")
        .when(c("o_orderstatus") == "F", "succeeded").otherwise("running")
    )
    rows = driver_table(spark, sf, "orders").select(
        key.alias("request_id"), state.alias("state"), (key % 130).alias("progress"),
        F.when(key % 7 == 0, F.lit("a.json")).alias("artifact_path"), F.when(key % 5 == 0, F.lit("x")).alias("artifact_sha256"),
        F.when(key % 5 == 0, F.lit(1)).alias("artifact_size_bytes"),
    )
    return rows.select("request_id", first_reason(J.job_rules()).alias("reason"))

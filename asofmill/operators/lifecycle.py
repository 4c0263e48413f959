"""Reports over the event history of jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import content_versions
from ..functions.ordered import HOT_ROWS, previous_values
from ..functions.rules import Rule, no

# The states of a job, the final ones and the allowed steps.
STATES = ("queued", "running", "succeeded", "failed", "interrupted", "cancelled")
FINAL_STATES = ("succeeded", "failed", "interrupted", "cancelled")
STEPS = (
    "queued>running", "queued>cancelled", "running>running", "running>succeeded", "running>failed",
    "running>interrupted", "running>cancelled",
)


def state_counts(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("state").agg(F.count(F.lit(1)).alias("jobs"))


def state_pivot(jobs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One column per state, zero where a state does not occur."""
    return jobs.groupBy(*by).agg(*[F.count_if(F.col("state") == s).alias(s) for s in STATES])


def recent_jobs(jobs: DataFrame, limit: int) -> DataFrame:
    """The newest jobs first; a bounded report."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be between 1 and 100")
    return jobs.orderBy(F.desc("created_at"), F.desc("request_id")).limit(limit)


def claimable(jobs: DataFrame) -> DataFrame:
    return jobs.where((F.col("state") == "queued") & ~F.coalesce(F.col("cancellation_requested"), F.lit(False)))


def next_claimable(jobs: DataFrame) -> DataFrame:
    return claimable(jobs).orderBy("created_at", "request_id").limit(1)


def history(jobs: DataFrame, events: DataFrame) -> DataFrame:
    """Jobs with their events. Order the result by ``sequence`` for reading."""
    return jobs.join(events.withColumnRenamed("state", "event_state"), "request_id")


def latest_states(events: DataFrame) -> DataFrame:
    """Newest state of each job with its first and last clock; combined before the shuffle."""
    return events.groupBy("request_id").agg(
        F.max_by("state", "sequence").alias("state"), F.min("at").alias("created_at"), F.max("at").alias("updated_at"),
        F.count(F.lit(1)).alias("events"),
    )


def illegal_transitions(events: DataFrame, slice_by: Column | None = None, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Steps that the job rules do not allow; the first event of a job has to be ``queued``."""
    sliced = slice_by if slice_by is not None else F.floor(F.col("sequence") / 1_000_000)
    stepped = previous_values(events, ["request_id"], ["sequence"], {"previous_state": F.col("state")}, sliced, hot_rows)
    step = F.concat_ws(">", "previous_state", "state")
    illegal = F.when(F.col("previous_state").isNull(), F.col("state") != "queued").otherwise(~step.isin(*STEPS))
    return stepped.where(illegal)


def resubmission_conflicts(requests: DataFrame) -> DataFrame:
    """Request ids submitted again with another run, kind or payload."""
    body = F.to_json(F.struct("run_id", "kind", "payload"), {"ignoreNullFields": "false"})
    return content_versions(requests, ["request_id"], body, "submissions")


def orphaned(events: DataFrame, restarted_at: Column) -> DataFrame:
    """Jobs still running when the worker restarted; they count as interrupted."""
    return latest_states(events.where(F.col("at") <= restarted_at)).where(F.col("state") == "running")


def job_rules() -> list[Rule]:
    """Rules of one stored job row."""
    c = F.col
    artifact = [c(n).isNotNull() for n in ("artifact_path", "artifact_sha256", "artifact_size_bytes")]
    return [
        ("unknown_state", no(c("state").isin(*STATES))),
        ("progress_range", no(c("progress").between(0, 100))),
        ("partial_artifact", (artifact[0] | artifact[1] | artifact[2]) & ~(artifact[0] & artifact[1] & artifact[2])),
        ("success_without_artifact", (c("state") == "succeeded") & ~artifact[1]),
    ]

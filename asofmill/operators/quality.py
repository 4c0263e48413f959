"""Data quality of a daily dataset, one finding per row. Missing sessions are reported, never filled."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joins import small_side
from ..functions.ordered import previous_values
from ..functions.rules import differs, duplicate_keys, yes
from . import calendars

# Finding codes and their severity.
SEVERITY = {
    "bar_order_or_duplicate": "error", "action_order_or_duplicate": "error", "execution_not_session": "error",
    "insufficient_warmup": "error", "listing_coverage": "error", "missing_bars": "error", "bar_provenance": "error",
    "unlisted_bar": "error", "unknown_session": "error", "session_hours": "error", "retrieval_timing": "error",
    "zero_volume": "error", "incomplete_actions": "error", "action_session": "error",
    "action_retrieval_timing": "error", "large_opening_gap": "warning", "unknown_revision_timing": "warning",
    "synthetic_data": "warning",
}
GAP_LIMIT = "0.20"


@dataclass(frozen=True)
class Plan:
    """The declared properties of a dataset; its universe is a table of its own."""

    origin: str
    provider: str
    feed: str
    coverage_start: date
    coverage_end: date
    first_execution_session: date
    warmup_sessions: int
    retrieved_at: datetime
    revision_policy: str = "point_in_time"
    zero_volume_policy: str = "allow_with_warning"
    corporate_actions_coverage: str = "complete"
    limitations: tuple[str, ...] = ()

    def faults(self) -> list[str]:
        """Rules that a plan has to meet before any row is looked at."""
        found = []
        if len(set(self.limitations)) != len(self.limitations):
            found.append("duplicate_limitations")
        if not self.coverage_start <= self.first_execution_session <= self.coverage_end:
            found.append("date_order")
        if self.revision_policy == "unknown" and "unknown_revision_timing" not in self.limitations:
            found.append("revision_limitation")
        if (self.origin == "synthetic") != ("synthetic_data" in self.limitations):
            found.append("synthetic_limitation")
        return found


def _finding(df: DataFrame, code: str | Column, severity: str | Column | None = None, session: bool = False) -> DataFrame:
    code_column = F.lit(code) if isinstance(code, str) else code
    if severity is None:
        severity = SEVERITY[code]
    return df.select(
        (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), code_column.alias("code"),
        (F.col("symbol") if "symbol" in df.columns else F.lit(None).cast("string")).alias("symbol"),
        (F.col("session") if session else F.lit(None).cast("date")).alias("session"),
    )


def sequence_faults(df: DataFrame, keys: list[str], arrival: str | None) -> DataFrame:
    """Rows that break strict ascending order of ``keys`` by arrival, or repeated keys where arrival is unknown.

    The whole table is one sequence, so it is cut into runs of arrival numbers instead of being sorted in one task.
    """
    if arrival is None:
        return duplicate_keys(df, keys).select(*keys)
    lagged = previous_values(
        df.select(*keys, arrival).withColumn("__all", F.lit(1)), ["__all"], [arrival],
        {f"__p_{k}": F.col(k) for k in keys}, F.floor(F.col(arrival) / 100_000), hot_rows=None,
    )
    here, before = F.struct(*keys), F.struct(*[F.col(f"__p_{k}").alias(k) for k in keys])
    return lagged.where(F.col(f"__p_{keys[0]}").isNotNull() & (here <= before)).select(*keys)


def session_coverage(universe: DataFrame, bars: DataFrame, sessions: DataFrame) -> DataFrame:
    """Expected, observed and missing sessions per instrument; the missing ones as a sorted array."""
    dates = calendars.calendar_of(sessions)
    missing = calendars.missing_sessions(universe, bars, dates).groupBy("symbol").agg(
        F.array_sort(F.collect_list("session")).alias("missing_sessions")
    )
    observed = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("observed_bars"))
    expected = calendars.expected_sessions(universe, dates).select("symbol", "expected_bars")
    empty = F.array().cast("array<date>")
    return (
        expected.join(observed, "symbol", "left").join(missing, "symbol", "left")
        .select(
            "symbol", "expected_bars", F.coalesce("observed_bars", F.lit(0)).alias("observed_bars"),
            F.coalesce("missing_sessions", empty).alias("missing_sessions"),
        )
    )


def opening_gaps(bars: DataFrame, splits: DataFrame) -> DataFrame:
    """Bars whose open is at least 20 % away from the previous close after same-session splits.

    ``|open / (close / ratio) - 1| >= 0.2`` is multiplied out, so it stays exact. A symbol has one row per session.
    """
    ratios = splits.select("symbol", F.col("effective_session").alias("session"), F.col("split_ratio").alias("ratio"))
    previous = bars.select(
        "symbol", "session", "open", F.lag("close").over(Window.partitionBy("symbol").orderBy("session")).alias("previous_close"),
    )
    joined = previous.join(small_side(ratios), ["symbol", "session"], "left").withColumn("ratio", F.coalesce("ratio", F.lit(1)))
    scaled = (F.col("open") * F.col("ratio").cast("decimal(10,0)")).cast("decimal(34,8)")
    base = F.col("previous_close").cast("decimal(34,8)")
    large = F.abs(scaled - base) >= (base * F.lit(GAP_LIMIT).cast("decimal(2,1)"))
    return joined.where(F.col("previous_close").isNotNull() & large)


def quality_findings(
    plan: Plan, universe: DataFrame, bars: DataFrame, actions: DataFrame, sessions: DataFrame,
    bar_arrival: str | None = None, action_arrival: str | None = None,
) -> DataFrame:
    """All findings as (severity, code, symbol, session)."""
    one = bars.sparkSession.range(1)
    dates = calendars.calendar_of(sessions)
    sessions = dates.sessions
    calendar = F.broadcast(sessions.select("session", "market_open", "market_close", F.lit(True).alias("__known")))
    listing = small_side(universe.select("symbol", "listed_on", "delisted_on"))

    joined = bars.join(calendar, "session", "left").join(listing, "symbol", "left")
    outside = ~calendars.is_listed(F.col("session"), F.col("listed_on"), F.col("delisted_on"))
    hours = F.col("__known").isNotNull() & (
        differs(F.col("interval_start"), F.col("market_open")) | differs(F.col("interval_end"), F.col("market_close"))
    )
    provenance = (
        differs(F.col("origin"), F.lit(plan.origin)) | differs(F.col("provider"), F.lit(plan.provider))
        | differs(F.col("feed"), F.lit(plan.feed))
    )
    retrieved = F.lit(plan.retrieved_at).cast("timestamp")
    per_bar = [
        ("bar_provenance", provenance), ("unlisted_bar", outside), ("unknown_session", F.col("__known").isNull()),
        ("session_hours", hours), ("retrieval_timing", F.col("first_ingested_at") > retrieved),
        ("zero_volume", F.col("volume") == 0),
    ]
    codes = F.array_compact(F.array(*[F.when(yes(c), F.lit(code)) for code, c in per_bar]))
    zero = "warning" if plan.zero_volume_policy == "allow_with_warning" else "error"
    row_level = _finding(
        joined.select("symbol", "session", F.explode(codes).alias("code")), F.col("code"),
        F.when(F.col("code") == "zero_volume", zero).otherwise("error"), session=True,
    )

    at_session = actions.join(
        F.broadcast(sessions.select(F.col("session").alias("effective_session"), F.lit(True).alias("__known"))),
        "effective_session", "left",
    ).join(listing, "symbol", "left")
    misplaced = F.col("__known").isNull() | ~calendars.is_listed(
        F.col("effective_session"), F.col("listed_on"), F.col("delisted_on")
    )
    late = F.col("first_ingested_at") > retrieved
    action_codes = F.array_compact(F.array(
        F.when(yes(misplaced), F.lit("action_session")), F.when(yes(late), F.lit("action_retrieval_timing"))
    ))
    action_level = _finding(
        at_session.select("symbol", F.explode(action_codes).alias("code")), F.col("code"), "error"
    )

    request = one.select(
        F.lit(plan.first_execution_session).alias("first_execution_session"),
        F.lit(plan.warmup_sessions).cast("bigint").alias("warmup_sessions"),
    )
    start = calendars.warmup_start(request, dates)
    required_start = start.select("required_start").scalar()
    listings = universe.where(
        (F.col("listed_on") > required_start)
        | yes(F.col("delisted_on") <= F.lit(plan.coverage_end))
    )
    splits = actions.where(F.col("kind") == "split").select("symbol", "effective_session", "split_ratio")
    bar_faults = sequence_faults(bars, ["symbol", "session"], bar_arrival)
    action_faults = sequence_faults(actions, ["symbol", "effective_session", "kind"], action_arrival).select("symbol")
    action_ids = duplicate_keys(actions, ["action_id"]).select(F.col("action_id").alias("symbol"))

    def any_row(df: DataFrame) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 0).select("n")

    parts = [
        row_level, action_level,
        _finding(any_row(bar_faults), "bar_order_or_duplicate"),
        _finding(any_row(action_faults.unionByName(action_ids)), "action_order_or_duplicate"),
        _finding(start.where(~F.col("is_execution_session")).select("required_start"), "execution_not_session"),
        _finding(start.where(~F.col("enough_warmup")).select("required_start"), "insufficient_warmup"),
        _finding(listings.select("symbol"), "listing_coverage"),
        _finding(calendars.missing_sessions(universe, bars, dates).select("symbol").distinct(), "missing_bars"),
        _finding(opening_gaps(bars, splits), "large_opening_gap", session=True),
    ]
    if plan.corporate_actions_coverage != "complete":
        parts.append(_finding(one.select("id"), "incomplete_actions"))
    if plan.revision_policy == "unknown":
        parts.append(_finding(one.select("id"), "unknown_revision_timing"))
    if plan.origin == "synthetic":
        parts.append(_finding(one.select("id"), "synthetic_data"))
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report


def is_usable(findings: DataFrame) -> DataFrame:
    """One row: true unless some finding is an error."""
    return findings.agg((~F.coalesce(F.bool_or(F.col("severity") == "error"), F.lit(False))).alias("usable"))

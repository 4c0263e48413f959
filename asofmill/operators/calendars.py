"""Session calendars.

A calendar has one row per exchange day, a few ten thousand rows for a century. It is read once per operator and kept in the
plan as constant rows: every join with it is then a broadcast of at most one row per day of its range, and positions and day
counts need no windows. (A broadcast passes through the driver as well.) Repeated rows count once. Two rows of one day that
differ belong to two exchanges and are refused, as a position would mean nothing.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clocks import available_after, is_shortened

#: The only day of the spine of an empty calendar: every date then has no sessions before it.
NO_SESSIONS = date(1970, 1, 1)


@dataclass(frozen=True)
class Calendar:
    """``sessions`` with their position from one, and ``spine``: each day from the first session to the day after the
    last with the number of sessions before it, which turns range conditions into equality joins on a date."""

    sessions: DataFrame
    spine: DataFrame
    first: date
    end: date


def calendar_of(sessions: DataFrame | Calendar) -> Calendar:
    if isinstance(sessions, Calendar):
        return sessions
    rows = sessions.where(F.col("session").isNotNull()).select("session", "market_open", "market_close").distinct()
    table = rows.orderBy("session").toArrow()
    days = table["session"].to_pylist()
    if len(set(days)) < len(days):
        raise ValueError("a calendar has two different rows for one session; pass the sessions of one exchange")
    ordinals = pa.array(range(1, len(days) + 1), pa.int64())
    start, end = (days[0], days[-1] + timedelta(days=1)) if days else (NO_SESSIONS, NO_SESSIONS)
    spine, counts, position = [], [], 0
    for offset in range((end - start).days + 1):
        day = start + timedelta(days=offset)
        spine.append(day)
        counts.append(position)
        position += position < len(days) and days[position] == day
    spark = sessions.sparkSession
    before = pa.table({"day": pa.array(spine, pa.date32()), "sessions_before": pa.array(counts, pa.int64())})
    return Calendar(
        spark.createDataFrame(table.append_column("ordinal", ordinals)), spark.createDataFrame(before), start, end
    )


def closures(sessions: DataFrame | Calendar, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Calendar days of the covered range on which there is no session."""
    calendar = calendar_of(sessions)
    first = start if start is not None else F.lit(calendar.first)
    last = end if end is not None else F.lit(calendar.end - timedelta(days=1))
    days = calendar.spine.sparkSession.range(1).select(F.explode(F.sequence(first, last)).alias("closed_on"))
    return days.join(F.broadcast(calendar.sessions.select("session")), F.col("closed_on") == F.col("session"), "left_anti")


def shortened(sessions: DataFrame) -> DataFrame:
    return sessions.where(is_shortened(F.col("market_open"), F.col("market_close"))).select("session")


def sessions_before(df: DataFrame, sessions: DataFrame | Calendar, day: str, name: str) -> DataFrame:
    """Add the number of sessions strictly before the date in ``day``; dates off the calendar are clamped to it."""
    calendar = calendar_of(sessions)
    clamped = df.withColumn("__day", F.least(F.greatest(F.col(day), F.lit(calendar.first)), F.lit(calendar.end)))
    counts = calendar.spine.select(F.col("day").alias("__day"), F.col("sessions_before").alias(name))
    return clamped.join(F.broadcast(counts), "__day", "left").drop("__day")


def warmup_start(requests: DataFrame, sessions: DataFrame) -> DataFrame:
    """Add ``prior_sessions``, ``enough_warmup``, ``is_execution_session`` and ``required_start`` to requests that
    carry ``first_execution_session`` and ``warmup_sessions``.

    ``required_start`` is the n-th session before execution; with no warmup, or too little, it is execution itself.
    """
    calendar = calendar_of(sessions)
    counted = sessions_before(requests, calendar, "first_execution_session", "prior_sessions")
    by_position = calendar.sessions.select(F.col("ordinal").alias("__pos"), F.col("session").alias("__start"))
    known = calendar.sessions.select(F.col("session").alias("__known"))
    wanted = F.when(F.col("warmup_sessions") > 0, F.col("prior_sessions") - F.col("warmup_sessions") + 1)
    return (
        counted.withColumn("__want", wanted)
        .join(F.broadcast(by_position), F.col("__want") == F.col("__pos"), "left")
        .join(F.broadcast(known), F.col("first_execution_session") == F.col("__known"), "left")
        .withColumn("enough_warmup", F.col("prior_sessions") >= F.col("warmup_sessions"))
        .withColumn("is_execution_session", F.col("__known").isNotNull())
        .withColumn("required_start", F.coalesce("__start", "first_execution_session"))
        .drop("__want", "__pos", "__start", "__known")
    )


def is_listed(day: Column, listed_on: Column, delisted_on: Column) -> Column:
    """Listing interval with an exclusive end; an unknown instrument is not listed."""
    return F.coalesce((day >= listed_on) & (delisted_on.isNull() | (day < delisted_on)), F.lit(False))


def expected_sessions(universe: DataFrame, sessions: DataFrame) -> DataFrame:
    """Number of listed sessions per instrument, without building the grid of symbols by sessions."""
    open_ended = universe.withColumn("__end", F.coalesce("delisted_on", F.lit("9999-12-31").cast("date")))
    calendar = calendar_of(sessions)
    counted = sessions_before(sessions_before(open_ended, calendar, "listed_on", "__from"), calendar, "__end", "__to")
    return counted.withColumn("expected_bars", F.greatest(F.col("__to") - F.col("__from"), F.lit(0))).withColumnRenamed(
        "__from", "first_position").withColumnRenamed("__to", "end_position").drop("__end")


def missing_sessions(universe: DataFrame, bars: DataFrame, sessions: DataFrame) -> DataFrame:
    """Listed sessions without a bar, as (symbol, session).

    Sessions are numbered; the holes between consecutive observed numbers of a symbol are its missing sessions. Only
    holes are produced, not the grid of all symbols by all sessions.
    """
    calendar = calendar_of(sessions)
    positions = calendar.sessions.select("session", "ordinal")
    listed = expected_sessions(universe, calendar).select("symbol", "first_position", "end_position")
    seen = (
        bars.select("symbol", "session").join(F.broadcast(positions), "session")
        .groupBy("symbol", "ordinal").agg(F.lit(1).alias("__seen")).select("symbol", "ordinal")
    )
    inside = seen.join(listed, "symbol").where(
        (F.col("ordinal") > F.col("first_position")) & (F.col("ordinal") <= F.col("end_position"))
    ).select("symbol", "ordinal")
    fences = listed.where(F.col("end_position") > F.col("first_position")).select(
        "symbol", F.explode(F.array(F.col("first_position"), F.col("end_position") + 1)).alias("ordinal")
    )
    step = Window.partitionBy("symbol").orderBy("ordinal")  # at most one row per session
    holes = (
        inside.unionByName(fences).withColumn("__prev", F.lag("ordinal").over(step))
        .where(F.col("ordinal") - F.col("__prev") > 1)
        .select("symbol", F.explode(F.sequence(F.col("__prev") + 1, F.col("ordinal") - 1)).alias("ordinal"))
    )
    return holes.join(F.broadcast(positions), "ordinal").select("symbol", "session")


def expected_pages(requests: DataFrame, sessions: DataFrame) -> DataFrame:
    """The page queries a history request stands for: one per session in range and one for corporate actions.

    The actions query spans all process dates, because the source filters by process date while the request is about
    economic dates; that range is applied after the scan. ``symbols`` is the sorted list of the request.
    """
    end_text = F.date_format(F.col("market_close") - F.expr("INTERVAL 1 MICROSECOND"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    days = requests.where(F.col("start_session") <= F.col("end_session")).withColumn(
        "session", F.explode(F.sequence("start_session", "end_session"))
    )
    per_session = days.join(F.broadcast(sessions), "session").select(
        "request_id", F.lit("/v2/stocks/bars").alias("path"), "symbols",
        F.date_format("market_open", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("start"), end_text.alias("end"),
    )
    actions = requests.select(
        "request_id", F.lit("/v1/corporate-actions").alias("path"), "symbols", F.lit("1970-01-01").alias("start"),
        F.to_date("requested_at").cast("string").alias("end"),
    )
    return per_session.unionByName(actions)


def request_rejects(requests: DataFrame, sessions: DataFrame) -> DataFrame:
    """First reason why a history request cannot be answered, null when it can."""
    calendar = calendar_of(sessions)
    counts = sessions_before(
        sessions_before(requests, calendar, "start_session", "__from"), calendar, "first_execution_session", "__at"
    )
    until = counts.withColumn("__next", F.date_add("end_session", 1))
    spanned = sessions_before(until, calendar, "__next", "__until")
    positions = calendar.sessions.select(F.col("ordinal").alias("__pos"), F.col("market_close").alias("__close"))
    positions_start = calendar.sessions.select(F.col("ordinal").alias("__wpos"), F.col("session").alias("__wsession"))
    known = calendar.sessions.select(F.col("session").alias("__known"))
    prior = F.col("__at") - F.col("__from")
    want = F.when(F.col("warmup_sessions") > 0, F.col("__at") - F.col("warmup_sessions") + 1)
    joined = (
        spanned.join(F.broadcast(positions), F.col("__until") == F.col("__pos"), "left")
        .withColumn("__want", want)
        .join(F.broadcast(positions_start), F.col("__want") == F.col("__wpos"), "left")
        .join(F.broadcast(known), F.col("first_execution_session") == F.col("__known"), "left")
    )
    empty = F.col("__until") <= F.col("__from")
    unfinished = available_after(F.col("__close")) > F.col("requested_at")
    in_range = F.col("first_execution_session").between(F.col("start_session"), F.col("end_session"))
    short = F.col("__known").isNull() | ~in_range | (prior < F.col("warmup_sessions"))
    start = F.coalesce("__wsession", "first_execution_session")
    late = (F.col("listed_on") > start) | (
        F.col("delisted_on").isNotNull() & (F.col("delisted_on") <= F.col("end_session"))
    )
    reason = (
        F.when(empty | unfinished, "unfinished_range").when(short, "insufficient_warmup").when(late, "listing_coverage")
    )
    return joined.select(*requests.columns, reason.alias("reason"))

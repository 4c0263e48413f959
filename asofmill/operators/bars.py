"""Rolling ticks and minutes up to bars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clocks import available_after, exchange_date, is_whole_minute, minutes_between, utc_text
from ..functions.exact import number_text
from ..functions.identity import canonical_json, ordered_digest
from .calendars import missing_sessions


def arrival_key(time: Column, tie: Column) -> Column:
    """A total order of (time, non-negative id) as one decimal.

    A struct would do, but it forces a sort-based aggregate; a decimal keeps the roll-up on hash aggregation.
    """
    return F.unix_micros(time).cast("decimal(19,0)") * F.lit("10000000000000000000").cast("decimal(20,0)") + tie.cast(
        "decimal(19,0)"
    )


def roll_up(
    ticks: DataFrame, keys: Sequence[str | Column], time: str = "t", tie: str = "id", price: str = "price",
    volume: str = "volume", extra: Sequence[Column] = (),
) -> DataFrame:
    """First, highest, lowest and last price and exact volume per group; combined before the shuffle."""
    ordered = ticks.withColumn("__at", arrival_key(F.col(time), F.col(tie)))
    return ordered.groupBy(*keys).agg(
        F.min_by(price, "__at").alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
        F.max_by(price, "__at").alias("close"), F.sum(volume).cast("bigint").alias("volume"), *extra,
    )


def in_session(ticks: DataFrame, sessions: DataFrame, time: str = "t") -> DataFrame:
    """Rows that fall in the half-open trading hours of their exchange date."""
    calendar = F.broadcast(sessions.select("session", "market_open", "market_close"))
    return ticks.join(calendar, exchange_date(F.col(time)) == F.col("session")).where(
        (F.col(time) >= F.col("market_open")) & (F.col(time) < F.col("market_close"))
    )


def daily_bars(ticks: DataFrame, sessions: DataFrame) -> DataFrame:
    """One raw bar per symbol and session with its interval and availability clocks."""
    rolled = roll_up(
        in_session(ticks, sessions), ["symbol", "session"],
        extra=[
            F.max("received_at").alias("first_ingested_at"),
            F.min("market_open").alias("interval_start"), F.min("market_close").alias("interval_end"),
        ],
    )
    return rolled.withColumn("available_at", available_after(F.col("interval_end")))


def interval_bars(ticks: DataFrame, width: str) -> DataFrame:
    """The same roll-up at another width: a ``date_trunc`` unit such as ``HOUR`` or ``WEEK``."""
    return roll_up(ticks, ["symbol", F.date_trunc(width, F.col("t")).alias("bucket")])


def minute_bars(ticks: DataFrame) -> DataFrame:
    """Ticks to minute rows; at most 1,440 remain per symbol and day whatever the tick count."""
    rolled = roll_up(
        ticks, ["symbol", F.date_trunc("MINUTE", F.col("t")).alias("minute")],
        extra=[F.max("received_at").alias("received_at")],
    )
    return rolled.withColumnRenamed("minute", "t")


def coverage_report(bars: DataFrame) -> DataFrame:
    """Bars, first and last session and zero-volume bars per symbol."""
    return (
        bars.groupBy("symbol")
        .agg(
            F.count(F.lit(1)).alias("bars"), F.min("session").alias("first_session"),
            F.max("session").alias("last_session"), F.count_if(F.col("volume") == 0).alias("zero_volume_bars"),
        )
        .orderBy("symbol")
    )


def minute_text() -> Column:
    """Canonical JSON of a minute row."""
    return canonical_json({
        "t": utc_text(F.col("t")), "v": F.col("v").cast("bigint"),
        **{name: number_text(F.col(name)) for name in ("o", "h", "l", "c")},
    })


def minute_completeness(minutes: DataFrame, sessions: DataFrame, universe: DataFrame | None = None) -> DataFrame:
    """Expected, observed and missing minutes per symbol and session, with the first missing minute.

    The first gap comes from comparing each minute with the one before it inside a session, so no grid is built.
    With a universe, listed sessions without any minute are reported too.
    """
    inside = in_session(minutes, sessions).where(is_whole_minute(F.col("t")))
    distinct = inside.groupBy("symbol", "session", "t").agg(
        F.first("market_open").alias("market_open"), F.first("market_close").alias("market_close")
    )
    # At most the minutes of one session per partition.
    previous = F.lag("t").over(Window.partitionBy("symbol", "session").orderBy("t"))
    minute = F.expr("INTERVAL 1 MINUTE")
    due = F.coalesce(previous + minute, F.col("market_open"))
    stepped = distinct.withColumn("__gap_at", F.when(F.col("t") > due, due))
    grouped = stepped.groupBy("symbol", "session").agg(
        F.min("market_open").alias("market_open"), F.min("market_close").alias("market_close"),
        F.count(F.lit(1)).alias("observed_minutes"), F.min("__gap_at").alias("__gap"), F.max("t").alias("__last"),
    )
    if universe is not None:
        empty = missing_sessions(universe, grouped.select("symbol", "session"), sessions).join(
            F.broadcast(sessions.select("session", "market_open", "market_close")), "session"
        )
        grouped = grouped.unionByName(
            empty.withColumn("observed_minutes", F.lit(0).cast("bigint")), allowMissingColumns=True
        )
    expected = minutes_between(F.col("market_open"), F.col("market_close"))
    tail = F.when(F.col("__last").isNull(), F.col("market_open")).when(
        F.col("__last") + minute < F.col("market_close"), F.col("__last") + minute
    )
    return grouped.select(
        "symbol", "session", expected.alias("expected_minutes"), "observed_minutes",
        (expected - F.col("observed_minutes")).alias("missing_minutes"),
        F.coalesce("__gap", tail).alias("first_missing"),
    )


def judged_bars(
    minutes: DataFrame, sessions: DataFrame, provider: str, feed: str, origin: str, universe: DataFrame | None = None
) -> DataFrame:
    """A row per symbol and session of accepted minutes (t, o, h, l, c, v, received_at): the daily bar, ``expected_minutes``,
    ``observed_minutes`` and ``reason``, which is ``missing_minutes`` where the session is not complete.

    ``revision_id`` is the digest of the session's canonical minutes in time order, a group bounded by the session. With a
    universe, listed sessions without any minute are rows too, with no prices.
    """
    inside = in_session(minutes, sessions).withColumn("__text", minute_text())
    grouped = inside.groupBy("symbol", "session").agg(
        F.min("market_open").alias("interval_start"), F.min("market_close").alias("interval_end"),
        F.min_by("o", "t").alias("open"), F.max("h").alias("high"), F.min("l").alias("low"),
        F.max_by("c", "t").alias("close"), F.sum("v").cast("bigint").alias("volume"),
        F.max("received_at").alias("first_ingested_at"), F.count(F.lit(1)).alias("observed_minutes"),
        F.min("t").alias("__first"), ordered_digest("__text", "t").alias("revision_id"),
    )
    if universe is not None:
        empty = missing_sessions(universe, grouped.select("symbol", "session"), sessions).join(sessions, "session").select(
            "symbol", "session", F.col("market_open").alias("interval_start"), F.col("market_close").alias("interval_end"),
            F.lit(0).cast("bigint").alias("observed_minutes"))
        grouped = grouped.unionByName(empty, allowMissingColumns=True)
    expected = minutes_between(F.col("interval_start"), F.col("interval_end"))
    complete = (F.col("observed_minutes") == expected) & (F.col("__first") == F.col("interval_start"))
    return grouped.select(
        F.lit(1).cast("tinyint").alias("schema_version"), "symbol", "session", F.lit("1d").alias("interval"),
        "interval_start", "interval_end", available_after(F.col("interval_end")).alias("available_at"),
        "first_ingested_at", F.lit(provider).alias("provider"), F.lit(feed).alias("feed"), "revision_id",
        F.lit(origin).alias("origin"), F.lit("raw").alias("adjustment"), F.lit("USD").alias("currency"),
        *[F.col(c).cast("decimal(24,8)").alias(c) for c in ("open", "high", "low", "close")], "volume",
        expected.alias("expected_minutes"), "observed_minutes", F.when(~F.coalesce(complete, F.lit(False)), "missing_minutes").alias("reason"),
    )


def regular_bars(
    minutes: DataFrame, sessions: DataFrame, provider: str, feed: str, origin: str, require_complete: bool = True
) -> DataFrame:
    """The bars of ``judged_bars``, by default of complete sessions only; what is left out has its reason there."""
    judged = judged_bars(minutes, sessions, provider, feed, origin)
    kept = judged.where(F.col("reason").isNull()) if require_complete else judged
    return kept.drop("expected_minutes", "observed_minutes", "reason")


def group_content_hash(minutes: DataFrame, keys: Sequence[str], text: Column, order: str) -> DataFrame:
    """Digest of each group's rows in order; for groups with a bound of their own."""
    return minutes.withColumn("__text", text).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("minutes"), ordered_digest("__text", order).alias("content_sha256")
    )

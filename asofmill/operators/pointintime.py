"""What could be known at a cutoff: as-of filters, effective splits, adjusted views, newest visible rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exact import half_even_quotient
from ..functions.joins import small_side


def as_of(df: DataFrame, cutoff: Column, available: str = "available_at", strict: bool = False) -> DataFrame:
    """Rows public at the cutoff (inclusive), or strictly before it. The filter reaches the scan."""
    return df.where(F.col(available) < cutoff if strict else F.col(available) <= cutoff)


def effective_splits(actions: DataFrame, sessions: DataFrame, cutoff: Column) -> DataFrame:
    """Splits whose session had opened by the cutoff."""
    opens = sessions.select(F.col("session").alias("effective_session"), F.col("market_open").alias("effective_at"))
    splits = actions.where(F.col("kind") == "split")
    return splits.join(F.broadcast(opens), "effective_session").where(F.col("effective_at") <= cutoff)


def late_splits(splits: DataFrame, cutoff: Column) -> DataFrame:
    """Effective splits that were not yet public at the cutoff: no honest adjusted view exists then."""
    return splits.where(F.col("available_at") > cutoff)


def require_timely(splits: DataFrame, cutoff: Column) -> DataFrame:
    """Fail the job, rather than return a wrong view, when an effective split was not yet public.

    The condition repeats the effective time, so it stays right wherever the optimizer evaluates it.
    """
    timely = (F.col("effective_at") > cutoff) | (F.col("available_at") <= cutoff)
    check = F.assert_true(timely, F.lit("an effective split was not available by the cutoff"))
    return splits.withColumn("__ok", check).where(F.col("__ok").isNull()).drop("__ok")


def split_schedule(splits: DataFrame) -> DataFrame:
    """One row per symbol with its splits as an array, broadcast where the splits are few.

    A symbol has a handful of splits in its life, so the arrays are short.
    """
    schedule = splits.groupBy("symbol").agg(
        F.collect_list(F.struct("effective_session", F.col("split_ratio").cast("bigint").alias("ratio"),
                                F.col("available_at").alias("known_at"))).alias("__splits")
    )
    return small_side(schedule, splits)


def later_splits(session: Column) -> Column:
    return F.filter(F.coalesce(F.col("__splits"), F.array().cast(
        "array<struct<effective_session:date,ratio:bigint,known_at:timestamp>>")),
        lambda s: s["effective_session"] > session)


def split_factor(session: Column) -> Column:
    """Exact product of the ratios of later splits; whole numbers, an overflow fails."""
    return F.aggregate(later_splits(session), F.lit(1).cast("bigint"), lambda total, s: total * s["ratio"])


def split_adjusted_view(
    bars: DataFrame, actions: DataFrame, sessions: DataFrame, cutoff: Column, fail_on_late: bool = True
) -> DataFrame:
    """Bars public at the cutoff with prices divided by the splits effective since.

    The raw bars are untouched, dividends and volume are not adjusted, and a row becomes available with the newest of
    its inputs. The join is on the symbol alone (one row per symbol on the right), so no bar-by-split pairs arise.
    """
    splits = effective_splits(actions, sessions, cutoff)
    if fail_on_late:
        splits = require_timely(splits, cutoff)
    visible = as_of(bars, cutoff).join(split_schedule(splits), "symbol", "left")
    factored = visible.withColumn("__factor", split_factor(F.col("session"))).withColumn(
        "__known", F.array_max(F.transform(later_splits(F.col("session")), lambda s: s["known_at"]))
    )
    return factored.select(
        "symbol", "session", F.greatest("available_at", "__known").alias("available_at"),
        F.col("__factor").alias("split_factor"),
        *[half_even_quotient(F.col(c), F.col("__factor")).alias(c) for c in ("open", "high", "low", "close")],
    )


def completed_features(features: DataFrame, splits: DataFrame, now: Column, value: str = "feature_close") -> DataFrame:
    """Feature rows public strictly before ``now``, older values in the share units of ``now``.

    ``splits`` carries symbol, effective_session, split_ratio, available_at and effective_at.
    """
    effective = splits.where(F.col("effective_at") <= now)
    visible = as_of(features, now, strict=True).join(split_schedule(effective), "symbol", "left")
    return visible.withColumn(value, half_even_quotient(F.col(value), split_factor(F.col("session")))).drop("__splits")


def latest_version(df: DataFrame, keys: Sequence[str], clock: str = "first_ingested_at", tie: str = "revision_id") -> DataFrame:
    """The newest version of each row, by ingestion time and then revision.

    An aggregate rather than a ranking window: versions are combined before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(clock, tie)).alias("__v"))
    return newest.select(*keys, *[F.col(f"__v.{c}").alias(c) for c in rest]).select(*df.columns)


def latest_version_as_of(df: DataFrame, keys: Sequence[str], cutoff: Column, available: str = "available_at",
                         tie: str = "revision_id") -> DataFrame:
    """The version of each row that was newest at the cutoff; later revisions stay invisible."""
    return latest_version(as_of(df, cutoff, available), keys, available, tie)


def match_observations(features: DataFrame, observations: DataFrame) -> DataFrame:
    """Why a feature row does not rest on a matching raw observation; null when it does."""
    keys = ["symbol", "session", "dataset_id"]
    raw = observations.select(*keys, F.col("available_at").alias("__available"),
                              F.col("first_ingested_at").alias("__ingested"), F.lit(True).alias("__found"))
    joined = features.join(raw, keys, "left")
    reason = (
        F.when(F.col("__found").isNull(), "no_observation")
        .when(F.col("available_at") < F.col("__available"), "available_before_observation")
        .when(F.col("computed_at") < F.col("__ingested"), "computed_before_ingestion")
    )
    return joined.withColumn("reason", reason).drop("__available", "__ingested", "__found")


def last_visible(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The newest visible row per decision: latest availability, then latest session."""
    rest = [c for c in df.columns if c not in keys]
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("available_at", "session")).alias("__v"))
    return newest.select(*keys, *[F.col(f"__v.{c}").alias(c) for c in rest])

"""Instants, sessions and their canonical text. The session time zone is UTC throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXCHANGE_ZONE = "America/New_York"
# The text form of an instant that carries an explicit offset.
OFFSET_TEXT = (
    r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})$"
)
DATE_TEXT = r"^\d{4}-\d{2}-\d{2}$"
AVAILABILITY_DELAY = "INTERVAL 15 MINUTES"
FULL_SESSION = "INTERVAL '6:30' HOUR TO MINUTE"


def utc_text(instant: Column) -> Column:
    return F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def offset_instant(text: Column) -> Column:
    """Parse text with a ``T`` and an offset; anything else (epoch numbers included) is null."""
    return F.when(text.rlike(OFFSET_TEXT), F.try_to_timestamp(text))


def session_date(text: Column) -> Column:
    """Parse an ISO date; timestamps are not dates."""
    return F.when(text.rlike(DATE_TEXT), text.try_cast("date"))


def exchange_date(instant: Column) -> Column:
    """The New York calendar date of an instant."""
    return F.to_date(F.from_utc_timestamp(instant, EXCHANGE_ZONE))


def is_whole_minute(instant: Column) -> Column:
    return F.date_trunc("MINUTE", instant) == instant


def available_after(close: Column) -> Column:
    """A completed bar counts as public fifteen minutes after its close."""
    return close + F.expr(AVAILABILITY_DELAY)


def is_shortened(market_open: Column, market_close: Column) -> Column:
    return (market_close - market_open) < F.expr(FULL_SESSION)


def minutes_between(start: Column, end: Column) -> Column:
    return F.floor((F.unix_micros(end) - F.unix_micros(start)) / F.lit(60_000_000)).cast("bigint")


def inclusive_days(start: Column, end: Column) -> Column:
    return F.datediff(end, start) + 1

"""Exact decimal numbers: 24 digits, 8 places, no binary floats on the way."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = "decimal(24,8)"
WIDE = "decimal(38,18)"


def as_number(wide: Column) -> Column:
    """Narrow a wide decimal (or its source text) to ``NUMBER``; null when a digit would be lost.

    A plain cast rounds a ninth decimal place silently, so the narrowed value is compared with the wide one.
    """
    exact = wide.try_cast(WIDE)
    narrow = exact.try_cast(NUMBER)
    return F.when(narrow.cast(WIDE) == exact, narrow)


def is_whole(value: Column) -> Column:
    return value == F.floor(value)


def whole(value: Column) -> Column:
    """A whole number as ``bigint``, null for fractions and for values outside the type."""
    return F.when(is_whole(value), value.try_cast("bigint"))


def number_text(value: Column) -> Column:
    """Canonical text: no exponent, no trailing zeros, ``0`` for every zero."""
    plain = value.cast("string")
    trimmed = F.regexp_replace(F.regexp_replace(plain, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return F.when(value == 0, F.lit("0")).otherwise(trimmed)


def half_even_quotient(value: Column, divisor: Column, places: int = 8) -> Column:
    """``value / divisor`` rounded half-even.

    The division keeps 22 places for a ``NUMBER`` over a whole divisor. A quotient that is not itself a tie stays
    farther from the nearest tie than that, so the second rounding is the only visible one.
    """
    return F.bround(value.cast(NUMBER) / divisor.cast("decimal(20,0)"), places).cast(NUMBER)


def is_price(value: Column) -> Column:
    return F.coalesce(value > 0, F.lit(False))


def is_weight(value: Column) -> Column:
    return F.coalesce(value.between(0, 1), F.lit(False))


def adverse_price(price: Column, bps: int, side: Column) -> Column:
    """Buy above and sell below the quoted price by ``bps``, rounded to cents."""
    shift = F.lit(bps).cast("decimal(10,0)") / F.lit(10000).cast("decimal(10,0)")
    factor = F.when(side == "buy", 1 + shift).otherwise(1 - shift).cast("decimal(10,6)")
    return F.round(price.cast("decimal(24,8)") * factor, 2).cast("decimal(20,2)")


def bid_ask(price: Column, bps: int) -> tuple[Column, Column]:
    """Synthetic execution quotes around an open, before rounding."""
    wide = price.cast(NUMBER)
    ticks = F.lit(10000).cast("decimal(6,0)")
    return (
        (wide * (10000 - bps) / ticks).cast("decimal(30,12)"),
        (wide * (10000 + bps) / ticks).cast("decimal(30,12)"),
    )

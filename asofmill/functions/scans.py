"""Running values in one pass over sliced keys: sums, extremes, last values, fixed frames.

A key is cut into slices of its order (``slice_by``, a monotone function of the first order column). One summary row per slice is
made with partial aggregates from the few columns it needs; the summaries of all earlier slices of a key, put together, open each
slice as its first row, where there is anything before it. Then one shuffle on key and slice and one window are the whole work, for hot keys and cold ones alike: no
key is counted beforehand, nothing is joined back, and no task holds more than a slice.

Keys may be null or absent (``keys=[]`` is one sequence). Order columns are named and ascend, nulls first.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SLICE, _DATA = "__slice", "__data"


class Scan(NamedTuple):
    """``kind`` is sum, max, min or last (the last value that is not null); ``before`` leaves the row itself out."""

    kind: str
    value: Column
    before: bool = False


_RUNNING = {"sum": F.sum, "max": F.max, "min": F.min, "last": lambda v: F.last(v, ignorenulls=True)}


def row_number() -> Scan:
    """The number of a row within its key, from one."""
    return Scan("sum", F.lit(1).cast("bigint"))


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], scans: dict[str, Scan], slice_by: Column) -> DataFrame:
    """All columns of ``df`` and one running value per scan."""
    values = {name: f"__v_{name}" for name in scans}
    rows = df.select("*", slice_by.alias(_SLICE), F.lit(True).alias(_DATA), *[s.value.alias(values[n]) for n, s in scans.items()])

    def total(name: str, scan: Scan) -> Column:
        value = F.col(values[name])
        if scan.kind == "last":
            return F.max_by(value, F.when(value.isNotNull(), F.struct(*order)))
        return _RUNNING[scan.kind](value)

    totals = rows.groupBy(*keys, _SLICE).agg(*[total(n, s).alias(values[n]) for n, s in scans.items()])
    # One row per key and slice.
    earlier = Window.partitionBy(*keys).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    opening = totals.select(*keys, _SLICE, F.lit(False).alias(_DATA), *[_RUNNING[s.kind](values[n]).over(earlier).alias(values[n]) for n, s in scans.items()])
    # The first slice of a key, often its only one, opens with nothing.
    opening = opening.where(reduce(lambda a, b: a | b, [F.col(v).isNotNull() for v in values.values()]))
    inside = Window.partitionBy(*keys, _SLICE).orderBy(_DATA, *order)
    frames = {before: inside.rowsBetween(Window.unboundedPreceding, -1 if before else 0) for before in (False, True)}
    found = rows.unionByName(opening, allowMissingColumns=True).select(
        *df.columns, _DATA, *[_RUNNING[s.kind](values[n]).over(frames[s.before]).alias(n) for n, s in scans.items()])
    return found.where(_DATA).drop(_DATA)


def moving(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, tuple[int, Column]], slice_by: Column,
           block: int = 65_536) -> DataFrame:
    """All columns of ``df`` and aggregates over the last so many rows of the key, the row itself included.

    ``values`` has a width and an aggregate by name. Rows are numbered and cut into blocks of ``block`` rows; the last rows of a block
    that a frame of the next one reaches also stand before it.
    """
    numbered = running(df, keys, order, {"__row_no": row_number()}, slice_by)
    spread, block_keys = _blocks(numbered, keys, max(w for w, _ in values.values()), block)
    inside = Window.partitionBy(*block_keys).orderBy("__row_no")
    framed = spread.select("*", *[value.over(inside.rowsBetween(1 - w, 0)).alias(name) for name, (w, value) in values.items()])
    return _own(framed).drop("__row_no")


def _blocks(numbered: DataFrame, keys: Sequence[str], width: int, block: int) -> tuple[DataFrame, list[str]]:
    """Rows numbered by ``__row_no`` with the blocks they stand in, and what a block is known by."""
    block = max(block, width)
    place = F.col("__row_no") - 1
    home = F.floor(place / block).cast("bigint")
    halo = F.when(place % block > block - width, F.array(home, home + 1)).otherwise(F.array(home))
    return numbered.withColumn("__home_block", home).withColumn("__in_block", F.explode(halo)), [*keys, "__in_block"]


def _own(framed: DataFrame) -> DataFrame:
    return framed.where(F.col("__in_block") == F.col("__home_block")).drop("__home_block", "__in_block")


def moving_sums(numbered: DataFrame, keys: Sequence[str], sums: dict[str, tuple[int, Column]], block: int = 65_536) -> DataFrame:
    """Rows numbered by the scan ``__row_no``, with exact sums of values that are not null over the last so many rows of the key.

    A sum is the total of its block up to the row less the total that many rows before: one addition per row, whatever the width.
    It is zero where all values of a frame are null.
    """
    spread, block_keys = _blocks(numbered, keys, max(w for w, _ in sums.values()), block)
    inside = Window.partitionBy(*block_keys).orderBy("__row_no")
    totals = spread.select("*", *[F.coalesce(F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)).alias(f"__t_{name}")
                                  for name, (_, value) in sums.items()])
    # Before the first row of a block nothing is to be taken off.
    found = totals.select(*numbered.columns, "__home_block", "__in_block", *[
        (F.col(f"__t_{name}") - F.coalesce(F.lag(f"__t_{name}", w).over(inside), F.lit(0))).alias(name) for name, (w, _) in sums.items()])
    return _own(found)


def islands(intervals: DataFrame, keys: Sequence[str], start: str, end: str, slice_by: Column) -> DataFrame:
    """Overlapping closed intervals of a key put together: keys, start, end, and ``intervals``, how many there were."""
    reach = running(intervals.select(*keys, start, end), keys, [start, end], {"__reach": Scan("max", F.col(end), True)}, slice_by)
    opens = (F.col("__reach").isNull() | (F.col(start) > F.col("__reach"))).cast("int")
    numbered = running(reach, keys, [start, end], {"__island": Scan("sum", opens)}, slice_by)
    return numbered.groupBy(*keys, "__island").agg(
        F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("intervals")).drop("__island")


def overlaps(left: DataFrame, right: DataFrame, keys: Sequence[str], start: str, end: str, unit: str = "MONTH", name: str = "overlaps") -> DataFrame:
    """``left`` with whether its closed interval meets one of ``right`` with the same keys (as two nulls are). No pairs are formed.

    Intervals of ``right`` are put together first. Of disjoint ones only the last that starts by the end of an interval can meet
    it, and a running last value finds that.
    """
    part = F.date_trunc(unit, F.col("__at").cast("timestamp"))
    merged = islands(right, keys, start, end, F.date_trunc(unit, F.col(start).cast("timestamp"))).select(
        *keys, F.col(start).alias("__at"), F.lit(0).alias("__side"), F.col(end).alias("__until"))
    both = left.select("*", F.col(end).alias("__at"), F.lit(1).alias("__side")).unionByName(merged, allowMissingColumns=True)
    found = running(both, keys, ["__at", "__side"], {"__last": Scan("last", F.col("__until"))}, part)
    return found.where(F.col("__side") == 1).select(*left.columns, F.coalesce(F.col("__last") >= F.col(start), F.lit(False)).alias(name))

"""Order-dependent operators that survive hot keys.

A plain window sends every row of a key to one task. Here rows of a hot key are cut into slices of the order
(``slice_by``, a monotone function of the first order column such as a day or a page number). Work runs inside the
slices, and one summary row per slice carries the state from each slice to the next. Cold keys go their own way: one
shuffle and one plain window, with no further join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A key with fewer rows than this is ordered in one task without trouble. The set of keys above it holds at most
# (rows / HOT_ROWS) entries - a million for 10^12 rows - which is what bounds the broadcast below.
HOT_ROWS = 1_000_000

_SLICE = "__slice"
_FIRST = "__first_in_slice"


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with at least ``hot_rows`` rows, counted with map-side combining."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= hot_rows).select(*keys)


def _on_keys(keys: Sequence[str], prefix: str) -> Column:
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(key).eqNullSafe(F.col(f"{prefix}{key}"))
    return condition


def _hot_side(hot: DataFrame, keys: Sequence[str]) -> DataFrame:
    return F.broadcast(hot.select(*[F.col(k).alias(f"__h_{k}") for k in keys], F.lit(True).alias("__hot")))


def cold_rows(df: DataFrame, keys: Sequence[str], hot: DataFrame | None) -> DataFrame | None:
    """Rows of keys that are not hot; None if every key is to be sliced."""
    if hot is None:
        return None
    return df.join(_hot_side(hot, keys), _on_keys(keys, "__h_"), "left_anti")


def hot_slices(df: DataFrame, keys: Sequence[str], slice_by: Column, hot: DataFrame | None) -> DataFrame:
    """Rows of hot keys with their slice; ``hot=None`` slices every key."""
    if hot is None:
        return df.withColumn(_SLICE, slice_by)
    joined = df.join(_hot_side(hot, keys), _on_keys(keys, "__h_"), "inner")
    return joined.drop("__hot", *[f"__h_{k}" for k in keys]).withColumn(_SLICE, slice_by)


def _both(cold: DataFrame | None, hot: DataFrame) -> DataFrame:
    return hot if cold is None else cold.unionByName(hot)


def _hot(df: DataFrame, keys: Sequence[str], hot_rows: int | None, hot: DataFrame | None) -> DataFrame | None:
    if hot is not None:
        return hot
    return None if hot_rows is None else hot_keys(df, keys, hot_rows)


def _carry(df: DataFrame, keys: Sequence[str], carried: DataFrame, values: Sequence[str]) -> DataFrame:
    """Attach the per-slice carry of the hot keys to every row of the slice."""
    renamed = carried.select(
        *[F.col(k).alias(f"__c_{k}") for k in (*keys, _SLICE)], *values
    )
    condition = _on_keys([*keys, _SLICE], "__c_")
    return df.join(renamed, condition, "left").drop(*[f"__c_{k}" for k in (*keys, _SLICE)])


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[Column],
    sums: dict[str, Column],
    slice_by: Column,
    hot_rows: int | None = HOT_ROWS,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Add cumulative sums per key, up to and including each row in ``order_by``.

    ``hot`` may name the hot keys where they are known from a cheaper table than ``df``.
    """
    hot = _hot(df, keys, hot_rows, hot)
    valued = df.select("*", *[value.alias(f"__v_{name}") for name, value in sums.items()])
    cold, sliced = cold_rows(valued, keys, hot), hot_slices(valued, keys, slice_by, hot)

    def local(rows: DataFrame, by: Sequence[str], prefix: str) -> DataFrame:
        window = Window.partitionBy(*by).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)
        return rows.select("*", *[F.sum(f"__v_{n}").over(window).alias(f"{prefix}{n}") for n in sums])

    if cold is not None:
        cold = local(cold, keys, "").select(*df.columns, *sums)
    totals = sliced.groupBy(*keys, _SLICE).agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in sums])
    earlier = Window.partitionBy(*keys).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*keys, _SLICE, *[F.sum(f"__t_{n}").over(earlier).alias(f"__c_{n}") for n in sums])
    joined = _carry(local(sliced, [*keys, _SLICE], "__s_"), keys, carried, [f"__c_{n}" for n in sums])
    with_carry = joined.select(
        *df.columns,
        *[
            F.when(F.col(f"__c_{n}").isNull(), F.col(f"__s_{n}"))
            .otherwise(F.col(f"__c_{n}") + F.coalesce(F.col(f"__s_{n}"), F.lit(0)))
            .alias(n)
            for n in sums
        ],
    )
    return _both(cold, with_carry)


def previous_values(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    values: dict[str, Column],
    slice_by: Column,
    hot_rows: int | None = HOT_ROWS,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Add the values of the row before, per key and in the order of the named columns (ascending)."""
    hot = _hot(df, keys, hot_rows, hot)
    valued = df.withColumn("__row", F.struct(*[value.alias(name) for name, value in values.items()]))
    cold, sliced = cold_rows(valued, keys, hot), hot_slices(valued, keys, slice_by, hot)
    unpacked = [F.col(f"__chosen.{name}").alias(name) for name in values]
    if cold is not None:
        before = F.lag("__row").over(Window.partitionBy(*keys).orderBy(*order_by))
        cold = cold.withColumn("__chosen", before).select(*df.columns, *unpacked)
    inside = Window.partitionBy(*keys, _SLICE).orderBy(*order_by)
    local = sliced.select(
        "*",
        F.lag("__row").over(inside).alias("__prev"),
        (F.row_number().over(inside) == 1).alias(_FIRST),
    )
    ends = sliced.groupBy(*keys, _SLICE).agg(F.max_by("__row", F.struct(*order_by)).alias("__end"))
    over_slices = Window.partitionBy(*keys).orderBy(_SLICE)
    carried = ends.select(*keys, _SLICE, F.lag("__end").over(over_slices).alias("__carry"))
    joined = _carry(local, keys, carried, ["__carry"])
    chosen = F.when(F.col(_FIRST), F.col("__carry")).otherwise(F.col("__prev"))
    return _both(cold, joined.withColumn("__chosen", chosen).select(*df.columns, *unpacked))


def latest_as_of(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_time: str,
    right_time: str,
    values: Sequence[str],
    slice_by: str = "DAY",
    strict: bool = False,
    tie_break: Sequence[str] = (),
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """For each left row the newest right row of its key at (or, if strict, before) its time.

    Both sides go through one shuffle as a union; neither is collected and no pairs are formed. ``slice_by`` is the
    ``date_trunc`` unit that cuts hot keys. Right rows with equal times are told apart by ``tie_break``.
    """
    left_row = F.struct(*[F.col(c) for c in left.columns])
    right_row = F.struct(*[F.col(c) for c in values])
    tie = F.struct(*[F.col(c) for c in tie_break]) if tie_break else F.struct(F.lit(0).alias("none"))
    # At equal times the right row goes first when the cutoff is inclusive and last when it is strict.
    left_side, right_side = (0, 1) if strict else (1, 0)
    rights = right.select(
        *keys, F.col(right_time).alias("__t"), F.lit(right_side).alias("__side"), tie.alias("__tie"),
        F.lit(None).alias("__left"), right_row.alias("__right"),
    )
    tie_type = rights.schema["__tie"].dataType
    lefts = left.select(
        *keys, F.col(left_time).alias("__t"), F.lit(left_side).alias("__side"), F.lit(None).cast(tie_type).alias("__tie"),
        left_row.alias("__left"), F.lit(None).cast(rights.schema["__right"].dataType).alias("__right"),
    )
    rights = rights.withColumn("__left", F.lit(None).cast(lefts.schema["__left"].dataType))
    union = lefts.unionByName(rights)
    # Counting keys needs neither payload, so this reads only key columns of the two sides.
    hot = _hot(left.select(*keys).unionByName(right.select(*keys)), keys, hot_rows, None)
    unit = F.date_trunc(slice_by, F.col("__t"))
    cold, sliced = cold_rows(union, keys, hot), hot_slices(union, keys, unit, hot)

    def local(rows: DataFrame, by: Sequence[str], name: str) -> DataFrame:
        window = Window.partitionBy(*by).orderBy("__t", "__side", "__tie").rowsBetween(Window.unboundedPreceding, 0)
        found = F.last("__right", ignorenulls=True).over(window)
        return rows.withColumn(name, found).where(F.col("__left").isNotNull())

    result = [F.col(f"__left.{c}").alias(c) for c in left.columns]
    result += [F.col(f"__best.{c}").alias(f"asof_{c}") for c in values]
    if cold is not None:
        cold = local(cold, keys, "__best").select(*result)
    ends = sliced.groupBy(*keys, _SLICE).agg(
        F.max_by("__right", F.when(F.col("__right").isNotNull(), F.struct("__t", "__tie"))).alias("__end")
    )
    earlier = Window.partitionBy(*keys).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, _SLICE, F.last("__end", ignorenulls=True).over(earlier).alias("__carry"))
    joined = _carry(local(sliced, [*keys, _SLICE], "__found"), keys, carried, ["__carry"])
    return _both(cold, joined.withColumn("__best", F.coalesce("__found", "__carry")).select(*result))

"""A fixed trend rule over moving averages, scaled by trailing volatility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.joins import small_side
from ..functions.scans import Scan, moving_sums, row_number, running
from ..session import staged

#: Returns are counted in this many parts of one, so that their sums are exact.
PARTS = 1_000_000_000


def _returns(bars: DataFrame, slice_by: Column) -> DataFrame:
    """Numbered rows with whole parts of return over the close before, rounded down; null without one."""
    before = running(bars, ["symbol"], ["session"], {"__before": Scan("last", F.col("close"), True), "__row_no": row_number()}, slice_by)
    now, then = F.col("close").cast("decimal(24,8)"), F.col("__before").cast("decimal(24,8)")
    units = lambda price: (price * 100_000_000).cast("decimal(28,0)")
    ratio = F.expr(f"CAST(__now * {PARTS} AS DECIMAL(38,0)) DIV __then") - PARTS
    return before.withColumns({"__now": units(now), "__then": F.when(then > 0, units(then))}).withColumn("__r", ratio).drop("__now", "__then", "__before")


def trend_signals(bars: DataFrame, fast: int, slow: int, window: int, slice_by: Column, block: int = 65_536) -> DataFrame:
    """``signal`` and ``volatility`` per symbol and session from closes up to that session.

    ``signal`` is ``above`` if the mean of the last ``fast`` closes is higher than that of the last ``slow``, ``below`` if lower,
    ``tie`` if equal (compared exactly), and ``warmup`` before there are ``slow`` closes. ``volatility`` is the sample deviation of
    the last ``window`` returns to nine places, as returns are counted; null before there are so many.
    """
    # Slices are summed up before their rows are read again.
    rows = _returns(staged(bars.select("symbol", "session", "close"), "trend-bars"), slice_by)
    close, r = F.col("close").cast("decimal(24,8)"), F.col("__r")
    square = (r.cast("decimal(14,0)") * r.cast("decimal(14,0)")).cast("decimal(28,0)")
    there = lambda value: value.isNotNull().cast("int")
    sums = moving_sums(rows, ["symbol"], {
        "__fast": (fast, close), "__slow": (slow, close), "__fast_k": (fast, there(close)), "__slow_k": (slow, there(close)),
        "__k": (window, there(r)), "__sum": (window, r), "__squares": (window, square),
    }, block)
    # Frames without any close have no mean.
    sums = sums.withColumns({name: F.when(F.col(f"{name}_k") > 0, F.col(name).cast("decimal(30,8)")) for name in ("__fast", "__slow")})
    up = F.col("__fast").cast("decimal(30,8)") * F.lit(slow).cast("decimal(6,0)")
    down = F.col("__slow").cast("decimal(30,8)") * F.lit(fast).cast("decimal(6,0)")
    signal = F.when(F.col("__row_no") < slow, "warmup").when(up > down, "above").when(up < down, "below").otherwise("tie")
    k = F.col("__k").cast("decimal(6,0)")
    spread = (k * F.col("__squares").cast("decimal(32,0)")).cast("decimal(38,0)") - (F.col("__sum").cast("decimal(19,0)") * F.col("__sum").cast("decimal(19,0)")).cast("decimal(38,0)")
    volatility = F.when(F.col("__k") == window, F.sqrt(spread.cast("double") / (window * (window - 1))) / PARTS)
    return sums.select("symbol", "session", "close", signal.alias("signal"), F.round(volatility, 9).alias("volatility"))


def trend_targets(signals: DataFrame, target: float, cap: float) -> DataFrame:
    """Weights per symbol and session with the reason for each: symbols that are ``above`` share the capital equally, each scaled by
    ``target`` over its volatility, at most by ``cap``. Zero or undefined volatility takes no weight; the rest stays cash."""
    signals = staged(signals, "trend-signals")
    counted = staged(signals.groupBy("session").agg(F.count_if(F.col("signal") == "above").alias("__above")), "trend-counts")
    vol = F.col("volatility")
    reason = (
        F.when(F.col("signal") != "above", F.col("signal")).when(vol.isNull(), "undefined_volatility")
        .when(vol == 0, "zero_volatility").when(target / vol > cap, "capped").otherwise("scaled")
    )
    weight = F.when(F.col("reason").isin("capped", "scaled"), F.least(F.lit(cap), target / vol) / F.col("__above")).otherwise(F.lit(0.0))
    return signals.join(small_side(counted), "session").withColumn("reason", reason).withColumn("weight", F.round(weight, 9)).drop("__above")

"""Loss conditions that stop an account until someone resets it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scans import Scan, running


def halts(equity: DataFrame, resets: DataFrame, keys: Sequence[str], daily_loss: Column, drawdown: Column, slice_by: Column,
          session: str = "session", value: str = "equity") -> DataFrame:
    """Where accounts stop and go on: (keys, session, event, reason), event ``tripped`` or ``reset``.

    A session trips if it lost at least ``daily_loss`` of the session before, or stands at least ``drawdown`` below the highest value
    since the last reset. A tripped account stays so until the next reset, whatever comes; later sessions that would trip give no
    row. A reset counts before its session's value, which then is the new base of both conditions; one without a trip before
    it gives no row.
    """
    marks = resets.select(*keys, session).distinct().withColumn("__kind", F.lit(0)).unionByName(
        equity.select(*keys, session, value).withColumn("__kind", F.lit(1)), allowMissingColumns=True)
    order = [session, "__kind"]
    cut = running(marks, keys, order, {"__part": Scan("sum", (F.col("__kind") == 0).cast("int"))}, slice_by)
    # What came before a reset is another part, so it is no base of what follows.
    based = running(cut, [*keys, "__part"], order, {"__last": Scan("last", F.col(value), True), "__peak": Scan("max", F.col(value), True)}, slice_by)
    lost = (F.col("__last") - F.col(value)).cast("double") >= daily_loss * F.col("__last").cast("double")
    fallen = (F.col("__peak") - F.col(value)).cast("double") >= drawdown * F.col("__peak").cast("double")
    reason = F.when(lost & (F.col("__last") > 0), "daily_loss").when(fallen & (F.col("__peak") > 0), "drawdown")
    judged = based.withColumn("reason", F.when(F.col("__kind") == 1, reason))
    mark = F.when(F.col("__kind") == 0, "reset").when(F.col("reason").isNotNull(), "tripped")
    latched = running(judged.withColumn("event", mark), keys, order, {"__was": Scan("last", F.col("event"), True)}, slice_by)
    changed = F.when(F.col("event") == "reset", F.col("__was").eqNullSafe("tripped")).otherwise(~F.col("__was").eqNullSafe("tripped"))
    return latched.where(F.col("event").isNotNull() & changed).select(*keys, session, "event", "reason")

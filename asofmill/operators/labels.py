"""Labels of forward returns that no training row shares time with what it is judged by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joins import small_side
from ..functions.scans import overlaps
from ..session import staged


def session_places(sessions: DataFrame) -> DataFrame:
    """(session, place): sessions numbered in order. A calendar has one row per day."""
    return sessions.select("session").distinct().withColumn("place", F.row_number().over(Window.orderBy("session")).cast("bigint"))


def forward_labels(bars: DataFrame, sessions: DataFrame, horizon: int, cutoff: Column, block: int = 256) -> DataFrame:
    """The return from the open of the next session to the open ``horizon`` sessions later, per symbol and session of ``bars``.

    ``bars`` has symbol, session, open and available_at; sessions count by the calendar, so a gap of a symbol gives no label. ``status``
    is ``no_entry`` or ``no_exit`` where that bar is missing, ``immature`` where the exit was not known by ``cutoff``, else ``ready``;
    ``forward_return`` is null unless ready. Bars of days that are no session take no part.

    Sessions are cut into blocks of ``block`` places; the first bars of a block, which labels of the block before reach, also stand
    after that one. Frames over places then find entry and exit: one shuffle and one sort, and a hot symbol spreads over its blocks.
    """
    reach = 1 + horizon
    block = max(block, reach)
    placed = bars.join(small_side(session_places(sessions)), "session").select("symbol", "session", "place", "open", "available_at")
    home = F.floor(F.col("place") / block).cast("bigint")
    halo = F.when(F.col("place") % block < reach, F.array(home, home - 1)).otherwise(F.array(home))
    spread = placed.select("*", home.alias("__home_block"), F.explode(halo).alias("__in_block"))
    inside = Window.partitionBy("symbol", "__in_block").orderBy("place")
    bar = F.max(F.struct("session", "open", "available_at"))
    met = spread.select("*", bar.over(inside.rangeBetween(1, 1)).alias("entry"), bar.over(inside.rangeBetween(reach, reach)).alias("exit"),
                        F.lag("place").over(inside).alias("__before"))
    status = (
        F.when(F.col("entry").isNull(), "no_entry").when(F.col("exit").isNull(), "no_exit")
        .when(~F.coalesce(F.col("exit.available_at") <= cutoff, F.lit(False)), "immature").otherwise("ready")
    )
    change = F.col("exit.open").cast("double") / F.nullif(F.col("entry.open").cast("double"), F.lit(0.0)) - 1
    # Of bars that share symbol and session one gives the label.
    own = (F.col("__in_block") == F.col("__home_block")) & ~F.col("place").eqNullSafe(F.col("__before"))
    return met.where(own).withColumn("status", status).select(
        "symbol", "session", F.col("entry.session").alias("label_start"), F.col("exit.session").alias("label_end"),
        "status", F.when(F.col("status") == "ready", change).alias("forward_return"))


def purged_split(labels: DataFrame, held_out: Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """Ready labels with ``part``: ``test`` where ``held_out`` (a condition on the session, so that all symbols of a date go together),
    ``purged`` where the time of a training label meets that of a test label, else ``train``.

    With ``keys`` only labels of equal keys are held against each other.
    """
    # Read four times.
    ready = staged(labels.where(F.col("status") == "ready").withColumn("__held", F.coalesce(held_out, F.lit(False))), "ready-labels")
    test, train = ready.where("__held"), ready.where(~F.col("__held"))
    met = overlaps(train, test, list(keys), "label_start", "label_end", name="__met")
    judged = met.withColumn("part", F.when(F.col("__met"), "purged").otherwise("train")).drop("__met")
    return judged.unionByName(test.withColumn("part", F.lit("test"))).drop("__held")

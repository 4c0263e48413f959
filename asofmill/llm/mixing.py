"""Mixing sources to target weights by capped water-filling and seeded sampling.

Every source has a weight and asks for its share of a budget of words; no source may give more than ``max_epochs`` times its
own words. Sources above their cap are clamped to it and their excess is shared among the others by weight, until no source is
above. A source whose target is r times its size gives each document floor(r) whole times; the fractional rest goes to the
documents with the smallest seeded hash, as many as come nearest to the missing words.

Defined results: a null text has no words; a null source is a source of its own and sorts last; a source without words has
target 0; rows that repeat an id share its draw; a null id draws like any other; extra columns are ignored; an empty table
gives an empty result.

Plan (DataFrame functions only): words are counted in one pass that writes id, source and size. Water-filling runs over one row
per source; each round is an aggregate that returns two numbers. The draw is a threshold on the hash: words are summed per
source and leading hash digits (``BINS`` at most per source, partial sums, so a hot source costs that many rows per task), and
only the bin in which the threshold lies is looked at row by row. Documents then meet their source's threshold in a plain join,
which adaptive execution splits for a hot source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import staged
from .rows import fresh, word_count

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MAX_EPOCHS = 2
SEED = 17
#: Leading hex digits of the hash: 16^3 bins per source.
DIGITS = 3


def draw(id_col: str | Column, seed: int = SEED) -> Column:
    """A seeded hash of the id as 32 hex digits; its order is the order of the draw."""
    column = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(F.coalesce(column.cast("string"), F.lit("")), F.lit(f"/{seed}")))


def numbered(sources: DataFrame) -> DataFrame:
    """Sources with their position by code point, null last, without a global window.

    A range sort numbers the rows of each partition; only the counts of the partitions are summed in one place.
    """
    placed = staged(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("_id", F.monotonically_increasing_id()), "source-order")
    part = F.shiftright("_id", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.withColumn("_before", F.coalesce(
        F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")
    inside = F.col("_id") - F.shiftleft(part, 33)
    return placed.join(offsets, part == F.col("_part")).select("source", "source_size", (F.col("_before") + inside).alias("position"))


def water_fill(sources: DataFrame, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, weight) with targets: the fixed point of clamping and resharing."""
    cap = F.col("source_size") * F.lit(max_epochs)
    total, spread = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    goal = budget * (total or 0)
    left, weights, clamped = goal, spread or 0, -1
    while True:
        level = F.lit(float(left)) * F.col("weight") / F.lit(float(weights)) if weights else cap
        above = level > cap
        held = sources.where(above).agg(F.count(F.lit(1)), F.sum(cap), F.sum("weight")).first()
        if held[0] == clamped or not weights:
            return sources.withColumn("target", F.when(above, cap).otherwise(level).cast("double"))
        clamped, left, weights = held[0], goal - (held[1] or 0), (spread or 0) - (held[2] or 0)


def thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: whole repetitions and the largest hash that gets one more (null: none)."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goals = targets.select("source", "source_size", "target", whole.alias("whole"),
                           (F.col("target") - whole * F.col("source_size")).alias("missing"))
    bins = sized.groupBy("source", F.substring("hash", 1, DIGITS).alias("bin")).agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(W.partitionBy("source").orderBy("bin").rowsBetween(W.unboundedPreceding, 0))
    crossing = bins.withColumn("upto", upto).join(goals.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).where(
        (F.col("upto") >= F.col("missing")) & (F.col("upto") - F.col("words") < F.col("missing"))).select(
        F.col("source").alias("_c"), "bin", (F.col("missing") - F.col("upto") + F.col("words")).alias("inside"))
    rows = sized.join(staged(crossing, "mix-bins"), F.col("source").eqNullSafe(F.col("_c")) & (F.substring("hash", 1, DIGITS) == F.col("bin")))
    units = rows.groupBy("source", "hash", "bin", "inside").agg(F.sum("size").alias("words"))
    running = F.sum("words").over(W.partitionBy("source").orderBy("hash").rowsBetween(W.unboundedPreceding, 0))
    # A document is taken while that brings the sum nearer: its middle lies below the goal.
    inside = units.withColumn("running", running).where(F.col("running") - F.col("words") / 2 <= F.col("inside"))
    last = inside.groupBy("source").agg(F.max("hash").alias("last"))
    cut = crossing.join(last.withColumnRenamed("source", "_l"), F.col("_c").eqNullSafe(F.col("_l")), "left").select(
        F.col("_c"), F.coalesce("last", "bin").alias("threshold"))
    return goals.join(cut, F.col("source").eqNullSafe(F.col("_c")), "left").select("source", "source_size", "target", "whole", "threshold")


def _plan(docs: DataFrame, weights, budget: float, max_epochs: int, seed: int, id_col: str, text_col: str, source_col: str):
    """Sizes and draws of all documents, and the plan per source (_source, source_size, target, whole, threshold)."""
    sized = staged(docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), word_count(text_col).alias("size"),
        draw(id_col, seed).alias("hash")), "mix-sizes")
    sources = numbered(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("position") % len(weights) + 1).cast("int"))
    targets = water_fill(staged(sources.withColumn("weight", weight), "mix-sources"), budget, max_epochs)
    return sized, staged(thresholds(sized, targets), "mix-plan").withColumnRenamed("source", "_source")


def _times(hash_value: Column) -> Column:
    return F.col("whole") + F.coalesce(hash_value <= F.col("threshold"), F.lit(False)).cast("long")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS,
        seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words the mix takes, repeats counted)."""
    sized, plan = _plan(docs, weights, budget, max_epochs, seed, id_col, text_col, source_col)
    return sized.join(plan, F.col("source").eqNullSafe(F.col("_source"))).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * _times(F.col("hash"))).alias("taken"))


def take_mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS,
             seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents of the mix with all their columns; a document taken twice is two rows.

    The draw depends on the id alone, so documents only meet the plan of their source.
    """
    _, plan = _plan(docs, weights, budget, max_epochs, seed, id_col, text_col, source_col)
    names = {c: fresh(docs.columns, f"_mix_{c}") for c in ("_source", "whole", "threshold", "times")}
    own = plan.select(F.col("_source").alias(names["_source"]), F.col("whole").alias(names["whole"]), F.col("threshold").alias(names["threshold"]))
    extra = F.coalesce(draw(id_col, seed) <= F.col(names["threshold"]), F.lit(False)).cast("long")
    joined = docs.join(own, docs[source_col].cast("string").eqNullSafe(F.col(names["_source"])))
    times = F.sequence(F.lit(1), F.col(names["whole"]) + extra)
    return joined.where(F.col(names["whole"]) + extra > 0).withColumn(names["times"], F.explode(times)).drop(*names.values())

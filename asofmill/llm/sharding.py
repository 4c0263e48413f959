"""Sharding by weighted rendezvous hashing of stable record keys.

Every shard draws a score from the hash of key and shard number; the record goes to the shard with the highest score. A score
of weight w is -w / ln(u) for u uniform in (0, 1), so shards get records in proportion to their weights. Scores of other shards
do not change when a shard is added, so the new shard takes records only into itself.

Within a shard, slots run from 0 without gaps, in the order of a hash of the key. Key and shard count alone decide the shard, so
records with equal texts are not held together.

Defined results: a null text has no bytes (size 1, crc32 0); a null key is a key of its own; rows that repeat a key share its
shard and get neighbouring slots; extra columns are ignored; an empty table gives an empty result.

Plan (DataFrame functions only): rows that agree in every result column are counted together before they move. Counts per shard
and leading hash bits (``RANGES`` per shard) give each range its first slot; inside a range rows are numbered by a window. A
range holds 1 / (shards x ranges) of the keys, and a repeated row comes back from its count, dealt out in runs of ``RUN``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import staged
from .rows import text_or_empty

SHARDS = 16
RANGES = 1024
RUN = 10_000


def shard_of(key: Column, weights: list[float]) -> Column:
    """Number of the shard with the highest score; a tie goes to the smaller number."""
    text = F.coalesce(key.cast("string"), F.lit("null"))

    def score(number: Column) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(text, number), 11)
        uniform = (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
        weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), number + 1)
        return F.struct((-weight / F.ln(uniform)).alias("score"), (-number).alias("number"))

    return -F.array_max(F.transform(F.sequence(F.lit(0), F.lit(len(weights) - 1)), score))["number"]


def sharded(docs: DataFrame, shards: int = SHARDS, weights: list[float] | None = None, new_weight: float = 1.0,
            id_col: str = "doc_id", text_col: str = "text", ranges: int = RANGES) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard (the shard with one shard more)."""
    weights = list(weights or [1.0] * shards)
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"))
    units = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies"))
    order = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    placed = staged(units.select(
        "*", shard_of(F.col("doc_id"), weights).alias("shard"), shard_of(F.col("doc_id"), [*weights, new_weight]).alias("grown_shard"),
        order.alias("order"), F.pmod(order, F.lit(ranges)).alias("range")), "shards")
    counts = placed.groupBy("shard", "range").agg(F.sum("copies").alias("rows"))
    before = F.coalesce(F.sum("rows").over(W.partitionBy("shard").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    first = staged(counts.withColumn("first", before).drop("rows"), "shard-ranges")
    inside = W.partitionBy("shard", "range").orderBy("order", "doc_id", "size", "text_crc32").rowsBetween(W.unboundedPreceding, -1)
    numbered = placed.withColumn("skip", F.coalesce(F.sum("copies").over(inside), F.lit(0))).join(first, ["shard", "range"])
    runs = numbered.withColumn("run", F.explode(F.sequence(F.lit(0), F.col("copies") - 1, F.lit(RUN))))
    return runs.withColumn("copy", F.explode(F.sequence(F.col("run"), F.least(F.col("run") + RUN, F.col("copies")) - 1))).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("first") + F.col("skip") + F.col("copy")).cast("long").alias("slot"), F.col("grown_shard").cast("int").alias("grown_shard"))

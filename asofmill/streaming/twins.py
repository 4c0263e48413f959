"""Streaming versions of four batch operators. The batch result is their specification.

Results that must hold whatever the order of arrival are merged on reading (``run_merged``): every micro-batch writes its own
partial aggregates to its own folder, and partial aggregates of all batches combine to the batch result. No row is late, no
state is kept, and a batch that is retried overwrites itself.

``bar_stream`` and ``deduplicated_stream`` emit once and for all in append mode instead. They drop rows that arrive later than
the delay, so the delay must bound the disorder of the input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.bars import arrival_key
from ..session import pin, scratch_path

DELAY = "15 minutes"


def file_stream(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return pin(spark).readStream.schema(schema).parquet(path)


def bar_stream(ticks: DataFrame, width: str, delay: str = DELAY) -> DataFrame:
    """Bars per symbol and window, emitted once the window is older than the delay (append mode)."""
    timed = ticks.withColumn("__at", arrival_key(F.col("t"), F.col("id"))).withWatermark("t", delay)
    rolled = timed.groupBy("symbol", F.window("t", width)).agg(
        F.min_by("price", "__at").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", "__at").alias("close"), F.sum("volume").cast("bigint").alias("volume"),
    )
    return rolled.select("symbol", F.col("window.start").alias("bucket"), "open", "high", "low", "close", "volume")


def deduplicated_stream(events: DataFrame, keys: list[str], clock: str, delay: str = DELAY) -> DataFrame:
    """The first delivery of each event id; repeats within the delay are dropped (append mode)."""
    return events.withWatermark(clock, delay).dropDuplicatesWithinWatermark(keys)


def fill_stream(events: DataFrame, order: str = "order_id") -> DataFrame:
    """Filled quantity and illegal-event flags per order (update mode).

    Quantities never shrink, so an order was overfilled at some point exactly if its sum exceeds the request.
    """
    filled = F.sum("fill_quantity_delta").cast("bigint")
    wanted = F.max("requested_quantity").cast("bigint")
    return events.groupBy(order).agg(
        filled.alias("filled_quantity"), wanted.alias("requested_quantity"), (filled > wanted).alias("overfilled"),
        F.count_if(F.col("recorded_at") < F.col("occurred_at")).alias("clock_violations"),
    )


def lifecycle_stream(events: DataFrame) -> DataFrame:
    """Newest state and event count per job (update mode)."""
    return events.groupBy("request_id").agg(
        F.max_by("state", "sequence").alias("state"), F.count(F.lit(1)).alias("events")
    )


def run_append(stream: DataFrame, label: str) -> DataFrame:
    """Drain what is available into a table in the shared folder and return that table."""
    spark = stream.sparkSession
    target = scratch_path(spark, label)
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{target}/checkpoint")
        .trigger(availableNow=True).start(f"{target}/rows")
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{target}/rows")


def run_update(stream: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Drain an update-mode stream and return the newest row per key.

    Each micro-batch overwrites its own folder, so a batch that is retried after a failure leaves one copy.
    """
    spark = stream.sparkSession
    target = scratch_path(spark, label)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/rows/batch={batch_id}")

    query = (
        stream.writeStream.outputMode("update").option("checkpointLocation", f"{target}/checkpoint")
        .foreachBatch(write).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    rest = [c for c in stream.columns if c not in keys]
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    rows = spark.read.schema(schema).option("basePath", f"{target}/rows").parquet(f"{target}/rows")
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("__r"))
    return newest.select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])


def run_merged(
    stream: DataFrame, partial: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame], DataFrame], label: str
) -> DataFrame:
    """Drain what is available into partial results per micro-batch and return ``merge`` of them.

    ``merge`` also sees the number of the batch as ``batch``.
    """
    spark = stream.sparkSession
    target = scratch_path(spark, label)

    def write(batch: DataFrame, batch_id: int) -> None:
        partial(batch).write.mode("overwrite").parquet(f"{target}/rows/batch={batch_id}")

    query = (
        stream.writeStream.option("checkpointLocation", f"{target}/checkpoint").foreachBatch(write)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    shape = partial(spark.createDataFrame([], stream.schema)).schema
    partial(spark.createDataFrame([], stream.schema)).write.mode("append").parquet(f"{target}/rows/batch=-1")
    schema = T.StructType([*shape.fields, T.StructField("batch", T.LongType())])
    return merge(spark.read.schema(schema).option("basePath", f"{target}/rows").parquet(f"{target}/rows"))


def merged_bars(ticks: DataFrame, width: str, delay: str = DELAY) -> DataFrame:
    """Bars of windows that lie ``delay`` behind the newest tick, with ``late_rows``: ticks that came in a batch after the
    window had already been that old."""

    def partial(rows: DataFrame) -> DataFrame:
        at = arrival_key(F.col("t"), F.col("id"))
        return rows.withColumn("__at", at).groupBy("symbol", F.window("t", width).alias("__w")).agg(
            F.min("__at").alias("first"), F.min_by("price", "__at").alias("open"), F.max("price").alias("high"),
            F.min("price").alias("low"), F.max("__at").alias("last"), F.max_by("price", "__at").alias("close"),
            F.sum("volume").cast("bigint").alias("volume"), F.max("t").alias("newest"), F.count(F.lit(1)).alias("rows"),
        ).select("symbol", F.col("__w.start").alias("bucket"), F.col("__w.end").alias("closes"), "first", "open", "high", "low",
                 "last", "close", "volume", "newest", "rows")

    def merge(parts: DataFrame) -> DataFrame:
        # One row per batch: the newest tick before it.
        batches = parts.groupBy("batch").agg(F.max("newest").alias("newest"))
        seen = F.max("newest").over(Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, -1))
        before = batches.select(F.col("batch").alias("__batch"), seen.alias("seen"))
        border = parts.agg(F.date_trunc("millisecond", F.max("newest"))).first()[0]
        delayed = F.expr(f"INTERVAL {delay}")
        closed = parts.where(F.col("closes") <= F.lit(border) - delayed).join(before, F.col("batch") == F.col("__batch"))
        return closed.groupBy("symbol", "bucket").agg(
            F.min_by("open", "first").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
            F.max_by("close", "last").alias("close"), F.sum("volume").cast("bigint").alias("volume"),
            F.coalesce(F.sum(F.when(F.col("closes") <= F.col("seen") - delayed, F.col("rows"))), F.lit(0)).alias("late_rows"),
        )

    return run_merged(ticks, partial, merge, "hourly-bars")


def merged_first_deliveries(events: DataFrame, keys: list[str]) -> DataFrame:
    """One delivery of each event: of the earliest micro-batch that held it."""
    rest = [c for c in events.columns if c not in keys]

    def merge(parts: DataFrame) -> DataFrame:
        first = parts.groupBy(*keys).agg(*[F.min_by(c, "batch").alias(c) for c in rest])
        return first.select(*keys, *rest)

    return run_merged(events, lambda rows: rows.dropDuplicates(keys), merge, "dedup")


def merged_fills(events: DataFrame, order: str = "order_id") -> DataFrame:
    """Filled quantity and illegal-event flags per order, as ``fill_stream``."""

    def partial(rows: DataFrame) -> DataFrame:
        return rows.groupBy(order).agg(
            F.sum("fill_quantity_delta").cast("bigint").alias("filled_quantity"),
            F.max("requested_quantity").cast("bigint").alias("requested_quantity"),
            F.count_if(F.col("recorded_at") < F.col("occurred_at")).alias("clock_violations"))

    def merge(parts: DataFrame) -> DataFrame:
        filled, wanted = F.sum("filled_quantity").cast("bigint"), F.max("requested_quantity")
        return parts.groupBy(order).agg(
            filled.alias("filled_quantity"), wanted.alias("requested_quantity"), (filled > wanted).alias("overfilled"),
            F.sum("clock_violations").cast("bigint").alias("clock_violations"))

    return run_merged(events, partial, merge, "fills")


def merged_lifecycles(events: DataFrame) -> DataFrame:
    """Newest state and event count per job, as ``lifecycle_stream``."""

    def partial(rows: DataFrame) -> DataFrame:
        return rows.groupBy("request_id").agg(
            F.max("sequence").alias("sequence"), F.max_by("state", "sequence").alias("state"), F.count(F.lit(1)).alias("events"))

    def merge(parts: DataFrame) -> DataFrame:
        return parts.groupBy("request_id").agg(F.max_by("state", "sequence").alias("state"), F.sum("events").cast("bigint").alias("events"))

    return run_merged(events, partial, merge, "jobs")

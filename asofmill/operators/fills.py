"""Execution events: shape rules, de-duplication, running fills and order status."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import HOT_ROWS, running_sums
from ..functions.rules import Rule, no

# Statuses that carry an execution, and those that end an order.
FILL_STATUSES = ("partial_fill", "filled")
TERMINAL_STATUSES = ("filled", "cancelled", "rejected", "expired")


def event_rules() -> list[Rule]:
    """Rules of one execution event, in checking order."""
    c = F.col
    fill = c("status").isin(*FILL_STATUSES)
    return [
        ("recorded_before_occurred", c("recorded_at") < c("occurred_at")),
        ("quantity_order", no((c("fill_quantity_delta") <= c("cumulative_filled_quantity"))
                              & (c("cumulative_filled_quantity") <= c("requested_quantity")))),
        ("fill_without_execution", fill & ((c("fill_quantity_delta") == 0) | c("fill_price_usd").isNull())),
        ("filled_short", (c("status") == "filled") & (c("cumulative_filled_quantity") != c("requested_quantity"))),
        ("partial_without_rest", (c("status") == "partial_fill")
         & (c("cumulative_filled_quantity") >= c("requested_quantity"))),
        ("execution_on_non_fill", ~fill & ((c("fill_quantity_delta") != 0) | c("fill_price_usd").isNotNull())),
        ("broker_outside_paper", (c("source") == "broker") & (c("mode") != "paper")),
        ("engine_order_missing", (c("source") == "engine") & (c("status") != "planned") & c("engine_order_id").isNull()),
        ("broker_order_missing", (c("source") == "broker")
         & c("status").isin("acknowledged", *FILL_STATUSES) & c("broker_order_id").isNull()),
    ]


def first_copies(events: DataFrame, event_id: str = "event_id") -> DataFrame:
    """One row per event id. Re-delivered copies are identical, so any of them will do."""
    return events.dropDuplicates([event_id])


def running_fills(
    events: DataFrame, order: str, delta: Column, order_by: Sequence[Column], slice_by: Column,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Cumulative filled quantity after each event of an order."""
    return running_sums(events, [order], order_by, {"running_filled": delta}, slice_by, hot_rows)


def fill_mismatches(running: DataFrame) -> DataFrame:
    """Events whose reported cumulative quantity is not the running sum, or that fill beyond the request."""
    reported = F.col("cumulative_filled_quantity") != F.col("running_filled")
    over = F.col("running_filled") > F.col("requested_quantity")
    return running.withColumn("mismatch", F.when(over, "overfilled").when(reported, "cumulative_mismatch")).where(
        F.col("mismatch").isNotNull()
    )


#: What can be wrong with an event within its order, in checking order.
FILL_FAULTS = ("recorded_before_occurred", "overfilled")


def judged_fills(events: DataFrame, order: str, slice_by: Column, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """One row per event with ``running_filled`` and ``illegal``: the first rule it breaks within its order, or null.

    An event is known by order, occurred_at and event_id. Copies count once; of several versions the one recorded last counts.
    """
    facts = ("recorded_at", "fill_quantity_delta", "requested_quantity")
    newest = events.groupBy(order, "occurred_at", "event_id").agg(F.max(F.struct(*facts)).alias("__v")).select(
        order, "occurred_at", "event_id", *[F.col(f"__v.{f}").alias(f) for f in facts])
    running = running_fills(newest, order, F.col("fill_quantity_delta"), [F.col("occurred_at"), F.col("event_id")], slice_by, hot_rows)
    broken = (F.col("recorded_at") < F.col("occurred_at"), F.col("running_filled") > F.col("requested_quantity"))
    illegal = F.coalesce(*[F.when(b, name) for name, b in zip(FILL_FAULTS, broken)])
    return running.select(order, "event_id", "occurred_at", *facts, "running_filled", illegal.alias("illegal"))


def order_status(events: DataFrame, order: str = "order_id") -> DataFrame:
    """Filled and open quantity and a status per order; one combined aggregate.

    ``requested_quantity`` is repeated on the events of an order, so any value of it serves.
    """
    grouped = events.groupBy(order).agg(
        F.sum("fill_quantity_delta").cast("bigint").alias("filled_quantity"),
        F.max("requested_quantity").cast("bigint").alias("requested_quantity"),
        F.count_if(F.col("fill_quantity_delta") > 0).alias("fills"),
        F.count_if(F.col("recorded_at") < F.col("occurred_at")).alias("clock_violations"),
    )
    filled, wanted = F.col("filled_quantity"), F.col("requested_quantity")
    return grouped.withColumn("open_quantity", F.greatest(wanted - filled, F.lit(0))).withColumn(
        "status",
        F.when(filled > wanted, "overfilled").when(filled == wanted, "filled").when(filled > 0, "partial_fill")
        .otherwise("acknowledged"),
    )


def events_after_terminal(events: DataFrame, order: str = "order_id") -> DataFrame:
    """Executions that occurred after an event that had ended their order."""
    ended = events.where(F.col("status").isin(*TERMINAL_STATUSES)).groupBy(order).agg(
        F.min(F.struct("occurred_at", "event_id")).alias("__end")
    )
    return events.join(ended, order).where(
        (F.struct("occurred_at", "event_id") > F.col("__end")) & (F.col("fill_quantity_delta") > 0)
    ).drop("__end")


def order_convention_fault(order_type: Column, time_in_force: Column, extended_hours: Column) -> Column:
    """Only market orders for the day in regular hours are supported."""
    fine = order_type.eqNullSafe("market") & time_in_force.eqNullSafe("day") & extended_hours.eqNullSafe(False)
    return F.when(~fine, "unsupported_order")

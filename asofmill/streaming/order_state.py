"""Which event of an order broke a rule: running fills per event from a stream, kept in keyed state.

The state of an order is its events in order of (occurred_at, event_id) with the quantity filled up to each, and the last of
them. An event behind the last one is appended. One that belongs further up, or that carries a newer version of a known event,
changes the rows after it: those are taken back (``change`` -1) and written anew (``change`` 1). A copy that says nothing new
changes nothing. So the rows that remain once both are added up are those of the batch result ``fills.judged_fills``, whatever
the order of arrival and the size of the batches.

A stream that runs on may give state a time to live, counted from when it was written. What has expired is settled: its rows stay,
and an event that arrives later and belongs among them counts from the first row that is still known. A run that ends when the
input is drained keeps all state: expiry goes by the clock, and a query that watches the clock never runs out of batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.fills import FILL_FAULTS, judged_fills
from .twins import run_merged

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_LONG = T.LongType()


def _longs(*names: str) -> T.StructType:
    return T.StructType([T.StructField(name, _LONG) for name in names])


_EVENT = ("occurred", "event_id", "recorded", "delta", "requested", "running")


class OrderFills(StatefulProcessor):
    """One order: its events in order, and the last of them."""

    def __init__(self, names: list[str], ttl_ms: int | None):
        self._ttl, self._named = ttl_ms, Row(*names)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._last = handle.getValueState("last", _longs("occurred", "event_id", "running"), self._ttl)
        self._events = handle.getListState("events", _longs(*_EVENT), self._ttl)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new: dict[tuple, tuple] = {}
        for r in rows:
            at, version = (r.occurred, r.event_id), (r.recorded, r.delta, r.requested)
            new[at] = max(version, new.get(at, version))
        if not new:
            return
        last = self._last.get()
        if last is None or min(new) > (last[0], last[1]):
            running, added = (last[2] if last else 0), []
            for at in sorted(new):
                running += new[at][1]
                added.append((*at, *new[at], running))
                yield self._row(key, added[-1], 1)
            self._events.appendList(added)
            self._last.update((*added[-1][:2], running))
            return
        known = [tuple(e) for e in self._events.get()]
        before = {e[:2]: e for e in known}
        fresh = {at: version for at, version in new.items() if at not in before or version > before[at][2:5]}
        if not fresh:
            return
        running = known[0][5] - known[0][3] if known else last[2]
        after = []
        for at in sorted(before.keys() | fresh.keys()):
            version = fresh.get(at) or before[at][2:5]
            running += version[1]
            after.append((*at, *version, running))
            if before.get(at) != after[-1]:
                if at in before:
                    yield self._row(key, before[at], -1)
                yield self._row(key, after[-1], 1)
        self._events.put(after)
        self._last.update((*after[-1][:2], running))

    def _row(self, key, event: tuple, change: int) -> Row:
        occurred, event_id, recorded, delta, requested, running = event
        broken = {"recorded_before_occurred": recorded < occurred, "overfilled": running > requested}
        return self._named(key[0], event_id, occurred, recorded, delta, requested, running, next((f for f in FILL_FAULTS if broken[f]), None), change)

    def close(self) -> None:
        pass


def fill_changes(events: DataFrame, order: str = "order_id", ttl_days: float | None = None) -> DataFrame:
    """Rows of events with ``change`` 1 where they are said and -1 where they are taken back (update mode).

    ``events`` has the order, event_id, occurred_at, recorded_at, fill_quantity_delta and requested_quantity. An event is known by
    order, time and id; of its versions the one recorded last counts. With ``ttl_days`` the query has to be stopped by whoever started
    it.
    """
    needed = events.select(
        order, F.col("event_id").cast("bigint").alias("event_id"), F.unix_micros("occurred_at").alias("occurred"),
        F.unix_micros("recorded_at").alias("recorded"), F.col("fill_quantity_delta").cast("bigint").alias("delta"),
        F.col("requested_quantity").cast("bigint").alias("requested"),
    )
    out = T.StructType([
        T.StructField(order, events.schema[order].dataType), *_longs("event_id", "occurred", "recorded", "delta", "requested", "running").fields,
        T.StructField("illegal", T.StringType()), T.StructField("change", T.IntegerType()),
    ])
    ttl = None if ttl_days is None else int(ttl_days * 86_400_000)
    clock_mode = "None" if ttl is None else "processingTime"
    changes = needed.groupBy(order).transformWithState(OrderFills(out.names, ttl), out, "Update", clock_mode)

    def clock(name: str) -> Column:
        return F.timestamp_micros(name)

    return changes.select(
        order, "event_id", clock("occurred").alias("occurred_at"), clock("recorded").alias("recorded_at"),
        F.col("delta").alias("fill_quantity_delta"), F.col("requested").alias("requested_quantity"),
        F.col("running").alias("running_filled"), "illegal", "change",
    )


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Keyed state with several variables needs the RocksDB store; other queries of the session keep theirs."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def remaining(parts: DataFrame) -> DataFrame:
    """What was said and not taken back."""
    facts = [c for c in parts.columns if c not in ("change", "batch")]
    return parts.groupBy(*facts).agg(F.sum("change").alias("change")).where("change > 0").select(*facts)


def judged_events(events: DataFrame, order: str = "order_id") -> DataFrame:
    """Drain what is available and return one row per event.

    Whoever drains a stream asks for what remains, not for what was taken back on the way. So every micro-batch writes its events
    and the rule is applied on reading, to the events of all batches: no state, no Python, and a hot order is cut into slices.
    ``fill_changes`` is for those who need each change as it happens.
    """
    columns = (order, "event_id", "occurred_at", "recorded_at", "fill_quantity_delta", "requested_quantity")
    longs = ("event_id", "fill_quantity_delta", "requested_quantity")
    needed = events.select(*[F.col(n).cast("bigint").alias(n) if n in longs else n for n in columns])
    return run_merged(needed, lambda rows: rows, lambda parts: judged_fills(parts, order, F.to_date("occurred_at")), "fill-events")

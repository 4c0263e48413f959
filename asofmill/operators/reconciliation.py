"""Reconciliation of two books of executions, such as the local ledger and a broker's statement: every record of either side is
accounted for once.

A book has the columns record_id (a whole number, unique in its book), native_id, symbol, side, quantity, at and price. Records
are paired one to one:

1. by ``native_id``: equal ids, the k-th record of an id with the k-th of the other book (by record_id); null ids pair with nothing
2. what is left, by symbol, side and quantity within ``seconds``: the closest two records pair first, then the closest two of
   those that are left, and so on. Of equal distances the earlier local record goes first, then the earlier one of the broker,
   then the smaller record ids. Records that lack one of these values or their time are not paired.

Pairs by distance come without forming candidates: records of one instant are one row with a count; a running last value forward
and one backward give each instant its nearest one of the other book; two that are nearest to each other are the pair the rule would
take, so all of these are taken at once, and the rest goes into the next round. A round is two passes over what may still find a
partner; there are as many as the longest chain of instants of which each is nearer to the next than to the one before it.
Counts become single records by position, so an instant that holds very many records is spread like any other rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scans import Scan, running
from ..session import staged

KEYS = ["symbol", "side", "quantity"]
VALUES = ("symbol", "side", "quantity", "price", "at")
_BLOCK = 1 << 20  # record ids that make one slice
_CHUNK = 4096  # pairs of one instant that are listed at a time
_DAY = 86_400_000_000


def _placed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows numbered from zero within their keys, by record id."""
    counted = running(rows, keys, ["record_id"], {"place": Scan("sum", F.lit(1).cast("bigint"))}, F.floor(F.col("record_id") / _BLOCK))
    return counted.withColumn("place", F.col("place") - 1)


def native_pairs(local: DataFrame, broker: DataFrame) -> DataFrame:
    """(local_id, broker_id) of records with equal native ids."""
    left, right = (_placed(book.where("native_id IS NOT NULL").select("record_id", "native_id"), ["native_id"])
                   .withColumnRenamed("record_id", name) for book, name in ((local, "local_id"), (broker, "broker_id")))
    return left.join(right, ["native_id", "place"]).select("local_id", "broker_id")


def nearest(batches: DataFrame, micros: int) -> DataFrame:
    """Instants (KEYS, book, t, ...) with ``mate``, the nearest instant of the other book, the earlier of two; those without go."""
    other = {"__of1": Scan("last", F.when(F.col("book") == 1, F.col("t"))), "__of0": Scan("last", F.when(F.col("book") == 0, F.col("t")))}
    mate = F.when(F.col("book") == 0, F.col("__of1")).otherwise(F.col("__of0"))
    # Of one instant the local book stands first going ahead and last going back, so either book meets the other's exactly once.
    ahead = running(batches, KEYS, ["t", "book"], other, F.floor(F.col("t") / _DAY)).withColumn("__before", mate).drop(*other)
    turned = ahead.withColumn("__t", -F.col("t")).withColumn("__book", -F.col("book"))
    both = running(turned, KEYS, ["__t", "__book"], other, F.floor(F.col("__t") / _DAY)).withColumn("__after", mate)
    back, forth = F.col("t") - F.col("__before"), F.col("__after") - F.col("t")
    chosen = F.when(forth.isNull() | (back <= forth), F.col("__before")).otherwise(F.col("__after"))
    return both.withColumn("mate", chosen).where(F.abs(F.col("mate") - F.col("t")) <= micros).select(*batches.columns, "mate")


def _spans(near: DataFrame) -> DataFrame:
    """Instants nearest to each other: how many records pair, and from which position in either book."""
    def book(n: int, prefix: str) -> DataFrame:
        return near.where(F.col("book") == n).select(*KEYS, *[F.col(name).alias(prefix + name) for name in ("t", "mate", "open", "taken")])
    both = book(0, "l_").withColumnRenamed("l_mate", "b_t").join(book(1, "b_").withColumnRenamed("b_mate", "l_t"), [*KEYS, "l_t", "b_t"])
    return both.select(*KEYS, "l_t", "b_t", "l_taken", "b_taken", F.least("l_open", "b_open").alias("pairs"))


def nearest_pairs(local: DataFrame, broker: DataFrame, seconds: int) -> DataFrame:
    """(local_id, broker_id) by the second rule."""
    books = local.withColumn("book", F.lit(0)).unionByName(broker.withColumn("book", F.lit(1))).where(
        " AND ".join(f"{n} IS NOT NULL" for n in (*KEYS, "at"))).select("record_id", "book", *KEYS, F.unix_micros("at").alias("t"))
    rows = staged(books, "reconcile-rows")
    left = rows.groupBy(*KEYS, "book", "t").agg(F.count(F.lit(1)).alias("open")).withColumn("taken", F.lit(0).cast("bigint"))
    found = None
    while True:
        near = staged(nearest(left, seconds * 1_000_000), "reconcile-near")
        if near.isEmpty():
            break
        spans = staged(_spans(near), "reconcile-spans")
        found = spans if found is None else found.unionByName(spans)
        used = spans.select(*KEYS, F.lit(0).alias("book"), F.col("l_t").alias("t"), "pairs").unionByName(
            spans.select(*KEYS, F.lit(1).alias("book"), F.col("b_t").alias("t"), "pairs"))
        now = F.coalesce("pairs", F.lit(0))
        left = near.drop("mate").join(used, [*KEYS, "book", "t"], "left").select(
            *KEYS, "book", "t", (F.col("open") - now).alias("open"), (F.col("taken") + now).alias("taken")).where("open > 0")
    if found is None:
        return rows.where("false").select(F.col("record_id").alias("local_id"), F.col("record_id").alias("broker_id"))
    chunks = found.withColumn("from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("pairs") - 1, F.lit(_CHUNK).cast("bigint"))))
    units = chunks.withColumn("n", F.explode(F.sequence("from", F.least(F.col("from") + _CHUNK, "pairs") - 1))).select(
        *KEYS, "l_t", "b_t", (F.col("l_taken") + F.col("n")).alias("l_place"), (F.col("b_taken") + F.col("n")).alias("b_place"))
    placed = _placed(rows, [*KEYS, "book", "t"])

    def book(n: int, prefix: str, name: str) -> DataFrame:
        return placed.where(F.col("book") == n).select(
            *KEYS, F.col("t").alias(prefix + "t"), F.col("place").alias(prefix + "place"), F.col("record_id").alias(name))
    return units.join(book(0, "l_", "local_id"), [*KEYS, "l_t", "l_place"]).join(
        book(1, "b_", "broker_id"), [*KEYS, "b_t", "b_place"]).select("local_id", "broker_id")


def _rest(book: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    return book.join(pairs.select(F.col(name).alias("record_id")), "record_id", "left_anti")


def reconcile(local: DataFrame, broker: DataFrame, seconds: int, price_tolerance: Column) -> DataFrame:
    """One row per pair and per record without one: local_id, broker_id, status, matched_by, differences.

    ``status`` is matched, differing, only_local or only_broker. ``differences`` names what differs within a pair: symbol, side,
    quantity, price (by more than ``price_tolerance``), at (by more than ``seconds``); one value present and one null differ.
    """
    local, broker = (staged(book.select("record_id", "native_id", *VALUES), "reconcile-book") for book in (local, broker))
    by_id = staged(native_pairs(local, broker), "reconcile-native")
    by_distance = nearest_pairs(_rest(local, by_id, "local_id"), _rest(broker, by_id, "broker_id"), seconds)
    pairs = staged(by_id.withColumn("matched_by", F.lit("native_id")).unionByName(by_distance.withColumn("matched_by", F.lit("nearest"))), "reconcile-pairs")
    ours, theirs = (book.select(F.col("record_id").alias(name), *[F.col(v).alias(prefix + v) for v in VALUES])
                    for book, name, prefix in ((local, "local_id", "l_"), (broker, "__other", "b_")))
    paired = ours.join(pairs, "local_id", "left")
    # Records without a partner are dealt by their own id; with a null key all of them would meet in one task.
    alone = F.col("broker_id").isNull()
    both = paired.withColumns({"__alone": alone, "__key": F.coalesce("broker_id", "local_id")}).join(
        theirs.select("*", F.lit(False).alias("__alone"), F.col("__other").alias("__key")), ["__alone", "__key"], "full")
    unlike = {v: ~F.col("l_" + v).eqNullSafe(F.col("b_" + v)) for v in KEYS}
    for name, apart in (("price", F.abs(F.col("l_price") - F.col("b_price")) > price_tolerance),
                        ("at", F.abs(F.unix_micros("l_at") - F.unix_micros("b_at")) > seconds * 1_000_000)):
        unlike[name] = F.coalesce(apart, F.col("l_" + name).isNull() != F.col("b_" + name).isNull())
    differences = F.array_compact(F.array(*[F.when(test, name) for name, test in unlike.items()]))
    status = F.when(F.col("__other").isNull(), "only_local").when(F.col("local_id").isNull(), "only_broker").when(F.size("differences") > 0, "differing").otherwise("matched")
    return both.withColumn("differences", F.when(F.col("local_id").isNotNull() & F.col("__other").isNotNull(), differences)).select(
        "local_id", F.col("__other").alias("broker_id"), status.alias("status"), "matched_by", "differences")

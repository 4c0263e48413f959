"""Streams fed in several batches end at the batch result."""

import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from asofmill.operators import fills as X
from asofmill.operators import lifecycle as J
from asofmill.operators.bars import interval_bars
from asofmill.operators.versions import rows_differ
from asofmill.streaming import order_state as K
from asofmill.streaming import twins as S

START = datetime(2024, 1, 1)


def _files(df, path, parts):
    """One file per part, in order, so that each trigger sees the next part."""
    for n, part in enumerate(parts):
        df.where(part).coalesce(1).write.mode("append").parquet(f"{path}/part{n}")
    return f"{path}/*"


def _stream(spark, df, path):
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_bars_wait_for_the_watermark_and_match_the_batch(spark, tmp_path):
    ticks = spark.range(3000).select(
        F.concat(F.lit("S"), (F.col("id") % 3).cast("string")).alias("symbol"),
        (F.lit(START) + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("id") / 5).cast("int"))).alias("t"),
        (F.col("id") % 97 + 1).cast("decimal(24,8)").alias("price"), (F.col("id") % 11).alias("volume"), "id",
    )
    path = _files(ticks, str(tmp_path / "in"), [F.col("id").between(1000 * i, 1000 * i + 999) for i in range(3)])
    got = S.run_append(S.bar_stream(_stream(spark, ticks, path), "1 hour"), "test-bars")
    last = START + timedelta(minutes=599) - timedelta(minutes=15)
    want = interval_bars(ticks, "HOUR").where(F.col("bucket") + F.expr("INTERVAL 1 HOUR") <= F.lit(last))
    assert want.count() == 27
    assert rows_differ(got, want).count() == 0


def test_repeated_deliveries_are_dropped(spark, tmp_path):
    events = spark.range(200).select((F.col("id") % 120).alias("event_id"), F.lit(START).alias("at"), (F.col("id") < 100).alias("first"))
    path = _files(events, str(tmp_path / "in"), [F.col("first"), ~F.col("first")])
    got = S.run_append(S.deduplicated_stream(_stream(spark, events, path), ["event_id"], "at"), "test-dedup")
    assert got.count() == 120 == X.first_copies(events).count()


def test_fill_and_job_state(spark, tmp_path):
    rows = spark.range(400).select(
        (F.col("id") % 20).alias("order_id"), (F.col("id") % 9).alias("fill_quantity_delta"), F.lit(80).cast("bigint").alias("requested_quantity"),
        F.lit(START).alias("occurred_at"), F.when(F.col("id") % 50 == 0, F.lit(START - timedelta(days=1))).otherwise(F.lit(START)).alias("recorded_at"),
        F.col("id").alias("sequence"), F.element_at(F.array(*[F.lit(s) for s in J.STATES]), (F.col("id") % 6 + 1).cast("int")).alias("state"),
    )
    path = _files(rows, str(tmp_path / "in"), [F.col("sequence") < 150, F.col("sequence").between(150, 299), F.col("sequence") >= 300])
    got = S.run_update(S.fill_stream(_stream(spark, rows, path)), ["order_id"], "test-fills")
    want = X.order_status(rows).select(
        "order_id", "filled_quantity", "requested_quantity", (F.col("status") == "overfilled").alias("overfilled"), "clock_violations"
    )
    assert rows_differ(got, want).count() == 0
    jobs = rows.select(F.col("order_id").alias("request_id"), "sequence", "state", F.lit(START).alias("at"))
    states = S.run_update(S.lifecycle_stream(_stream(spark, rows, path).select(F.col("order_id").alias("request_id"), "sequence", "state")),
                          ["request_id"], "test-jobs")
    assert rows_differ(states, J.latest_states(jobs).select("request_id", "state", "events")).count() == 0


@pytest.mark.parametrize("files", [1, 4, 16])
def test_any_number_of_files_in_any_order(spark, tmp_path, files):
    """Rows of a year dealt over files at random, one file per trigger: the result is that of one batch."""
    rows = spark.range(2000).select(
        F.concat(F.lit("S"), (F.col("id") % 3).cast("string")).alias("symbol"), "id",
        (F.lit(START) + F.make_dt_interval((F.col("id") * 7919 % 365).cast("int"), (F.col("id") % 24).cast("int"))).alias("t"),
        (F.col("id") % 97 + 1).cast("decimal(24,8)").alias("price"), (F.col("id") % 11).alias("volume"), (F.col("id") % 700).alias("event_id"),
        (F.col("id") % 20).alias("order_id"), (F.col("id") % 9).alias("fill_quantity_delta"), F.lit(400).cast("bigint").alias("requested_quantity"),
        F.lit(START).alias("occurred_at"), F.when(F.col("id") % 50 == 0, F.lit(START - timedelta(days=1))).otherwise(F.lit(START)).alias("recorded_at"),
        F.col("id").alias("sequence"), F.element_at(F.array(*[F.lit(s) for s in J.STATES]), (F.col("id") % 6 + 1).cast("int")).alias("state"))
    rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(files))).repartition(files, "part").write.partitionBy("part").parquet(str(tmp_path / "in"))
    path = str(tmp_path / "in" / "*")
    bars = S.merged_bars(_stream(spark, rows, path).select("symbol", "t", "price", "volume", "id"), "1 hour")
    newest = rows.agg(F.max("t")).first()[0]
    want = interval_bars(rows.select("symbol", "t", "price", "volume", "id"), "HOUR").where(
        F.col("bucket") + F.expr("INTERVAL 1 HOUR") <= F.lit(newest - timedelta(minutes=15)))
    assert rows_differ(bars.drop("late_rows"), want).count() == 0
    assert (bars.agg(F.sum("late_rows")).first()[0] > 0) == (files > 1)
    assert S.merged_first_deliveries(_stream(spark, rows, path).select("event_id", "t"), ["event_id"]).count() == 700
    fills = X.order_status(rows).select("order_id", "filled_quantity", "requested_quantity", (F.col("status") == "overfilled").alias("overfilled"), "clock_violations")
    assert rows_differ(S.merged_fills(_stream(spark, rows, path)), fills).count() == 0
    jobs = rows.select(F.col("order_id").alias("request_id"), "sequence", "state", F.lit(START).alias("at"))
    merged = S.merged_lifecycles(_stream(spark, rows, path).select(F.col("order_id").alias("request_id"), "sequence", "state"))
    assert rows_differ(merged, J.latest_states(jobs).select("request_id", "state", "events")).count() == 0


def _fill_events(spark):
    """Events of one hot and many small orders, with copies and corrections that were recorded later."""
    rows = spark.range(900).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 40).alias("order_id"), (F.col("id") * 7919 % 601).alias("event_id"),
        (F.lit(START) + F.make_dt_interval((F.col("id") * 31 % 50).cast("int"))).alias("occurred_at"),
        (F.lit(START) + F.make_dt_interval((F.col("id") * 31 % 50 + F.when(F.col("id") % 11 == 0, -1).otherwise(1)).cast("int"))).alias("recorded_at"),
        (F.col("id") % 9).alias("fill_quantity_delta"), F.lit(90).cast("bigint").alias("requested_quantity"))
    later = rows.where("event_id % 5 = 0").withColumn("fill_quantity_delta", F.col("fill_quantity_delta") + 2).withColumn(
        "recorded_at", F.col("recorded_at") + F.expr("INTERVAL 2 DAYS"))
    return rows.unionByName(later).unionByName(rows.where("event_id % 4 = 0"))


@pytest.mark.parametrize("files", [1, 4, 16])
def test_every_event_is_judged_in_any_order(spark, tmp_path, files):
    rows = _fill_events(spark).withColumn("n", F.monotonically_increasing_id())
    rows.withColumn("part", F.pmod(F.xxhash64("n"), F.lit(files))).repartition(files, "part").write.partitionBy("part").parquet(str(tmp_path / "in"))
    got = K.judged_events(_stream(spark, rows, str(tmp_path / "in" / "*")))
    want = X.judged_fills(rows, "order_id", F.to_date("occurred_at"))
    assert rows_differ(got, want).count() == 0
    assert {r.illegal for r in got.select("illegal").distinct().collect()} == {None, *X.FILL_FAULTS}
    assert rows_differ(want, X.judged_fills(rows, "order_id", F.to_date("occurred_at"), hot_rows=50)).count() == 0


def test_a_late_event_takes_rows_back(spark, tmp_path):
    schema = "order_id string, event_id bigint, occurred_at timestamp, recorded_at timestamp, fill_quantity_delta bigint, requested_quantity bigint, part int"
    at = lambda n: START + timedelta(hours=n)
    rows = spark.createDataFrame([("a", 1, at(1), at(1), 5, 9, 0), ("a", 3, at(3), at(3), 4, 9, 0), ("a", 2, at(2), at(2), 1, 9, 1), ("a", 3, at(3), at(3), 4, 9, 2)], schema)
    path = _files(rows, str(tmp_path / "in"), [F.col("part") == n for n in range(3)])
    with K.rocksdb_state(spark):
        said = S.run_merged(K.fill_changes(_stream(spark, rows, path)), lambda r: r, lambda r: r, "changes")
    found = sorted((r.batch, r.event_id, r.running_filled, r.illegal, r.change) for r in said.collect())
    assert found == [(0, 1, 5, None, 1), (0, 3, 9, None, 1), (1, 2, 6, None, 1), (1, 3, 9, None, -1), (1, 3, 10, "overfilled", 1)]
    assert spark.conf.get(K.PROVIDER, None) != K.ROCKSDB


def test_state_expires(spark, tmp_path):
    """After the time to live nothing of the order is known, so its next event starts from nothing."""
    schema = "order_id string, event_id bigint, occurred_at timestamp, recorded_at timestamp, fill_quantity_delta bigint, requested_quantity bigint, part int"
    rows = spark.createDataFrame([("a", n, START + timedelta(hours=n), START + timedelta(hours=n), 5, 9, n) for n in range(2)], schema)
    path = _files(rows, str(tmp_path / "in"), [F.col("part") == n for n in range(2)])
    for ttl, running in ((1e-6, 5), (1, 10)):
        said = []

        def keep(batch, _):
            said.extend(batch.collect())  # noqa: B023

        with K.rocksdb_state(spark):
            query = K.fill_changes(_stream(spark, rows, path), ttl_days=ttl).writeStream.outputMode("update").option(
                "checkpointLocation", str(tmp_path / f"checkpoint-{ttl}")).foreachBatch(keep).start()
            until = time.time() + 60
            while len(said) < 2 and time.time() < until:
                time.sleep(0.2)
            query.stop()
        assert {r.event_id: r.running_filled for r in said} == {0: 5, 1: running}


def test_drained_events_need_no_state(spark, tmp_path, monkeypatch):
    """Draining runs no Python per order, and values that are missing break no rule, as in the batch."""
    monkeypatch.setattr(K, "fill_changes", lambda *_: pytest.fail("state per order"))
    rows = _fill_events(spark).withColumn("recorded_at", F.when(F.col("event_id") % 7 != 0, F.col("recorded_at"))).withColumn("n", F.monotonically_increasing_id())
    rows = rows.withColumn("fill_quantity_delta", F.when(F.col("event_id") % 13 != 0, F.col("fill_quantity_delta")))
    got = K.judged_events(_stream(spark, rows, _files(rows, str(tmp_path / "in"), [F.col("n") % 3 == n for n in range(3)])))
    assert rows_differ(got, X.judged_fills(rows, "order_id", F.to_date("occurred_at"))).count() == 0

"""Publishing, reading back, reports and version differences."""

import hashlib

import pytest
from pyspark.sql import functions as F

from asofmill import schemas
from asofmill.operators import bars as B
from asofmill.operators import quality as Q
from asofmill.operators.capture import latest_receipts
from asofmill.operators.versions import version_diff
from asofmill.sinks import publish as W
from asofmill.sources import tables as R

from . import fixtures as T


def _publish(spark, root, rows=None, **plan):
    return W.publish_snapshot(
        root, T.plan(**plan), T.universe(spark), T.bars(spark, rows).drop("arrival"), T.actions(spark).drop("arrival"), T.sessions(spark)
    )


def test_same_content_same_id_and_changes_keep_the_old_version(spark, tmp_path):
    root = str(tmp_path)
    first = _publish(spark, root)
    assert _publish(spark, root) == first
    changed = T.bar_rows()
    changed[5]["close"] = T.D("63.5")
    second = _publish(spark, root, changed)
    assert second != first
    old, new = (R.snapshot_table(spark, root, "bars", i) for i in (first, second))
    assert old.count() == new.count() == 6
    assert spark.read.parquet(f"{root}/manifest").count() == 2
    difference = version_diff(old.drop("dataset_id"), new.drop("dataset_id"), ["symbol", "session"]).collect()
    assert [tuple(r) for r in difference] == [("BBTEST", T.DAYS[5], "changed")]
    with pytest.raises(ValueError):
        R.snapshot_table(spark, root, "bars", "no-digest")


def test_version_scan_is_pruned(spark, tmp_path, capsys):
    root = str(tmp_path)
    found = _publish(spark, root)
    R.snapshot_table(spark, root, "bars", found).where(F.col("available_at") <= T.lit_time("2024-07-03 00:00:00")).explain()
    text = capsys.readouterr().out
    assert "PartitionFilters: [isnotnull(dataset_id" in text and "LessThanOrEqual(available_at" in text


def test_rejected_dataset_is_not_written(spark, tmp_path):
    rows = T.bar_rows()
    del rows[3]
    with pytest.raises(W.QualityRejected, match="missing_bars"):
        _publish(spark, str(tmp_path / "x"), rows)
    with pytest.raises(W.QualityRejected, match="synthetic_limitation"):
        _publish(spark, str(tmp_path / "x"), limitations=())
    assert not (tmp_path / "x").exists()


def test_schema_is_checked(spark, tmp_path):
    path = str(tmp_path / "bars")
    W.write_table(T.bars(spark).drop("arrival"), path)
    assert R.parquet_table(spark, path, schemas.BARS).count() == 6
    W.write_table(T.bars(spark).drop("arrival").withColumn("volume", F.col("volume").cast("double")), str(tmp_path / "other"))
    with pytest.raises(schemas.SchemaMismatch):
        R.parquet_table(spark, str(tmp_path / "other"), schemas.BARS)


def test_inspection_report_and_digests(spark, tmp_path):
    findings = Q.quality_findings(T.plan(), T.universe(spark), T.bars(spark), T.actions(spark), T.sessions(spark))
    report = W.inspection_report("0" * 64, B.coverage_report(T.bars(spark)), findings)
    path = str(tmp_path / "report")
    W.write_report(report.select("report"), path)
    files = [f for f in (tmp_path / "report").iterdir() if f.name.endswith(".txt")]
    digests = {r["sha256"]: r["size_bytes"] for r in R.file_digests(spark, path + "/*.txt").collect()}
    assert digests == {hashlib.sha256(f.read_bytes()).hexdigest(): f.stat().st_size for f in files}
    assert '"bars":6' in report.first()["report"] and '"first_session":"2024-07-01"' in report.first()["report"]


def test_captures_and_receipts(spark, tmp_path):
    path = str(tmp_path / "pages")
    pages = T.pages_frame(spark, T.bar_pages())
    W.write_table(pages, path)
    W.append_captures(pages.unionByName(pages.withColumn("capture_id", F.lit("d"))), spark.read.schema(pages.schema).parquet(path), path)
    assert T.key_set(spark.read.parquet(path).groupBy("capture_id").count(), "capture_id", "count") == [("c", 4), ("d", 4)]
    receipts = spark.createDataFrame([("r", "c", T.at(T.DAYS[0], 1)), ("r", "d", T.at(T.DAYS[1], 1))],
                                     "request_id string, capture_id string, completed_at timestamp")
    W.append_receipt(receipts, str(tmp_path / "receipts"))
    assert latest_receipts(spark.read.parquet(str(tmp_path / "receipts"))).first()["capture_id"] == "d"


def test_capture_files_and_text_tables(spark, tmp_path):
    body = '{"a": 1}'
    good = hashlib.sha256(body.encode()).hexdigest()
    (tmp_path / "captures").mkdir()
    (tmp_path / "captures" / f"{good}.json").write_text(body)
    (tmp_path / "captures" / f"{'0' * 64}.json").write_text(body)
    rows = {r["capture_id"]: r["corrupt"] for r in R.capture_files(spark, str(tmp_path / "captures")).collect()}
    assert rows == {good: False, "0" * 64: True}
    (tmp_path / "f.csv").write_text("session,available_at,feature_close,instruction\n2024-07-01,2024-07-01T16:15:00-04:00,105,buy\n")
    assert R.csv_table(spark, str(tmp_path / "f.csv"), schemas.FEATURES_CSV).first()["feature_close"] == 105
    (tmp_path / "u.json").write_text('[{"symbol": "A", "exchange": "X", "listed_on": "2024-01-01", "delisted_on": null}]')
    assert R.json_table(spark, str(tmp_path / "u.json"), schemas.UNIVERSE, multi_line=True).first()["symbol"] == "A"


def test_a_changed_plan_is_another_version(spark, tmp_path):
    first = _publish(spark, str(tmp_path))
    assert _publish(spark, str(tmp_path), limitations=("synthetic_data", "fixed_declared_universe")) != first


def test_impossible_records_are_refused(spark, tmp_path):
    rows = T.bar_rows()
    rows[2]["low"] = T.D("999")
    with pytest.raises(W.QualityRejected, match="unsupported_records bars.price_order x1"):
        _publish(spark, str(tmp_path / "x"), rows)
    assert not (tmp_path / "x").exists()


def test_extra_columns_and_other_row_counts_are_refused(spark, tmp_path):
    path = str(tmp_path / "bars")
    W.write_table(T.bars(spark).drop("arrival"), path)
    assert R.parquet_table(spark, path, schemas.BARS, rows=6).count() == 6
    with pytest.raises(schemas.SchemaMismatch):
        R.parquet_table(spark, path, schemas.BARS, rows=7)
    W.write_table(T.bars(spark).drop("arrival").withColumn("more", F.lit(1)), str(tmp_path / "more"))
    with pytest.raises(schemas.SchemaMismatch):
        R.parquet_table(spark, str(tmp_path / "more"), schemas.BARS)


def test_a_stored_capture_is_not_replaced(spark, tmp_path):
    path = str(tmp_path / "pages")
    pages = T.pages_frame(spark, T.bar_pages())
    W.write_table(pages, path)
    stored = spark.read.schema(pages.schema).parquet(path)
    W.append_captures(pages, stored, path)
    with pytest.raises(W.CaptureConflict, match="c"):
        W.append_captures(pages.withColumn("body", F.concat("body", F.lit(" "))), stored, path)
    assert spark.read.parquet(path).count() == 4

"""Capture files on disk: every file is accepted or refused with its reason."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from asofmill.functions import wire as W
from asofmill.sources import captures as C
from asofmill.sources.tables import spread


def instrument(**changes):
    return {"asset_class": "us_etf", "calendar": "XNYS", "currency": "USD", "delisted_on": None, "exchange": "ARCA", "listed_on": "2010-01-04",
            "symbol": "SPY", "timezone": "America/New_York", **changes}


def request(**changes):
    return {"schema_version": 1, "universe": [instrument()], "start_session": "2024-01-02", "end_session": "2024-01-31",
            "first_execution_session": "2024-01-10", "warmup_sessions": 3, "interval": "1d", "feed": "sip", "adjustment": "raw",
            "aggregation": "regular_session_from_1min", "zero_volume_policy": "reject", **changes}


def page(**changes):
    return {"schema_version": 1, "path": "/v2/stocks/bars", "params": {"start": "2024-01-02T14:30:00Z", "limit": 10000},
            "received_at": "2024-02-01T10:00:01Z", "request_id": None, "body": '{"bars":{},"next_page_token":null}', **changes}


def capture(**changes):
    return {"schema_version": 1, "adapter_version": "minutes.v1", "origin": "historical", "request": request(), "requested_at": "2024-02-01T10:00:00Z",
            "captured_at": "2024-02-01T10:05:00Z", "pages": [page()], **changes}


def without(record, name):
    return {k: v for k, v in record.items() if k != name}


CASES = [
    (None, capture()),
    (None, capture(pages=[page(), page(path="/v1/corporate-actions", request_id="é", params={}, body='{"größe":1.50}')])),
    (None, capture(request=request(universe=[without(instrument(), "delisted_on"), instrument(symbol="QQQ", delisted_on="2020-01-02")]))),
    ("invalid_fields", without(capture(), "origin")), ("invalid_fields", capture(extra=1)), ("invalid_fields", capture(schema_version="1")),
    ("invalid_fields", capture(pages=[page(), without(page(), "request_id")])), ("invalid_fields", capture(pages=[page(params={"limit": True})])),
    ("invalid_fields", capture(pages={})), ("invalid_fields", capture(request=[])),
    ("invalid_value", capture(schema_version=2)), ("invalid_value", capture(origin="prospective")), ("invalid_value", capture(captured_at="2024-02-01T10:05:00")),
    ("invalid_page", capture(pages=[])), ("invalid_page", capture(pages=[page(path="/other")])), ("invalid_page", capture(pages=[page(body="1")])),
    ("invalid_page", capture(pages=[page(request_id="r" * 129)])),
    ("page_outside_capture", capture(pages=[page(), page(received_at="2024-02-01T10:05:01Z")])),
    ("request_fields", capture(request=request(warmup_sessions="3"))), ("request_fields", capture(request=without(request(), "feed"))),
    ("request_version", capture(request=request(schema_version=2))),
    ("request_value", capture(request=request(feed="otc"))), ("request_value", capture(request=request(warmup_sessions=-1))),
    ("request_universe", capture(request=request(universe=[]))), ("request_universe", capture(request=request(universe=[instrument(), instrument()]))),
    ("request_universe", capture(request=request(universe=[instrument(symbol="spy")]))),
    ("request_universe", capture(request=request(universe=[instrument(delisted_on="2010-01-04")]))),
    ("request_universe", capture(request=request(universe=[instrument(), instrument(symbol="B", extra=1)]))),
    ("request_dates", capture(request=request(start_session="2015-12-31"))), ("request_dates", capture(request=request(end_session="2024-02-30"))),
    ("request_dates", capture(request=request(first_execution_session="2024-01-01"))),
]


def canonical(record):
    return json.dumps(record, sort_keys=True, separators=(",", ":")).encode()


@pytest.fixture(scope="module")
def judged(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("captures")
    contents = [(reason, canonical(record)) for reason, record in CASES]
    sound = canonical(capture(origin="synthetic"))
    contents += [("not_utf8", b'{"a":"\xff"}'), ("invalid_json", b'{"a":1,"a":2}'), ("invalid_json", sound + b"{}"),
                 ("not_canonical", sound + b"\n"), ("not_canonical", json.dumps(capture()).encode()), ("invalid_fields", b"{}")]
    expected = {}
    for reason, data in contents:
        path = folder / f"{hashlib.sha256(data).hexdigest()}.json"
        path.write_bytes(data)
        expected[path.name] = reason
    for name, reason in ((f"{'0' * 64}.json", "checksum_mismatch"), ("notes.txt", "unnamed_file")):
        (folder / name).write_bytes(sound)
        expected[name] = reason
    rows = C.judged_files(C.read_files(spark, str(folder)))
    return rows, expected


def test_every_file_is_accounted_for(judged):
    rows, expected = judged
    assert {r.path.rsplit("/", 1)[1]: r.reason for r in rows.collect()} == expected
    refused = C.quarantine(rows)
    assert refused.count() == sum(reason is not None for reason in expected.values())


def test_pages_of_accepted_files(judged):
    rows, expected = judged
    pages = C.accepted_pages(rows.unionByName(rows.withColumn("path", F.concat(F.lit("/copy"), "path"))))
    got = sorted((tuple(r) for r in pages.select("seq", "path", "request_id", "body", F.map_entries("params")).collect()), key=str)
    assert [g[0] for g in got] == [0, 0, 0, 1]
    assert got[-1][:4] == (1, "/v1/corporate-actions", "é", '{"größe":1.50}')
    assert {p[0]: p[1] for p in got[0][4]} == {"start": "2024-01-02T14:30:00Z", "limit": "10000"}


def test_an_empty_file_is_no_capture(spark):
    """Spark's file readers leave files without bytes out; a table that has them gets a verdict."""
    files = spark.createDataFrame([(f"/x/{hashlib.sha256(b'').hexdigest()}.json", bytearray()), (None, None)], "path string, content binary")
    assert {r.reason for r in C.judged_files(files).collect()} == {"invalid_json", "unnamed_file"}
    assert C.judged_files(files.limit(0)).count() == 0 and C.accepted_pages(C.judged_files(files)).count() == 0


def test_only_one_version(spark):
    data = canonical(capture())
    files = spark.createDataFrame([(f"/x/{hashlib.sha256(data).hexdigest()}.json", bytearray(data))], "path string, content binary")
    assert [C.judged_files(files, version).first().reason for version in ("minutes.v1", "minutes.v2")] == [None, "invalid_value"]


def test_rows_are_handed_out_where_a_file_has_one_group_of_rows(spark, tmp_path):
    """Many splits of a file with one row group leave all rows to one task."""
    spark.range(40_000).selectExpr("id", "sha2(cast(id AS string), 256) AS text").coalesce(1).write.parquet(str(tmp_path / "one"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        table = spark.read.parquet(str(tmp_path / "one"))
        assert table.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        counts = [r["count"] for r in spread(table).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert sum(counts) == 40_000 and max(counts) * spark.sparkContext.defaultParallelism <= 2 * 40_000


def test_a_body_is_parsed_for_all_rules_at_once(spark):
    judged = C.judged_files(spark.createDataFrame([("x", b"{}")], "path string, content binary"))
    plan = judged._jdf.queryExecution().optimizedPlan().toString()
    # Once for the rules, twice in the strict reading and the canonical form of texts that need them.
    assert plan.count("parseJson") <= 4


@pytest.mark.parametrize("text", ['{"a":1.5}', '{"a":"1.5"}', '{"a":"#"}', '{"a":"é"}', '{"a":"\\u00e9"}', '{"a":1e2}', '{"a":1,"b":[2]}', '{"b":1,"a":2}', '{"a": 1}',
                                  '{"a":-0}', '{"a":1} ', '{"a":1}{}', '{"a":1,"a":1}', '{"a":NaN}', '{"a":12345678901234567890}', '{"a":"\\/"}', '{"a":"x\\"#f1.5"}', "[1]", ""])
def test_a_canonical_text_is_known_as_such(spark, text):
    c = F.col("text")
    got = spark.createDataFrame([(text,)], "text string").select(W.is_canonical(c, F.try_parse_json(c)).alias("is"), (W.canonical_text(c) == c).alias("want")).first()
    # What follows a value is the matter of the strict reading, but such a text never counts as canonical.
    assert bool(got["is"]) == bool(got["want"])

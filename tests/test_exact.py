"""Exact numbers, instants, canonical text, strict JSON and redaction."""

from datetime import datetime
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from asofmill.functions import clocks, exact, identity
from asofmill.functions.text import redact
from asofmill.operators.capture import strict_json_reason


def one(spark, expression, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize("text, want", [
    ("1.5", D("1.5")), ("0.12345678", D("0.12345678")), ("0.123456789", None), ("1234567890123456.12345678", D("1234567890123456.12345678")),
    ("12345678901234567.1", None), ("NaN", None), ("Infinity", None), ("abc", None), ("0.100000000000", D("0.1")),
])
def test_numbers_never_lose_a_digit(spark, text, want):
    assert one(spark, exact.as_number(F.col("v")), v=text) == want


@pytest.mark.parametrize("text, want", [("100", "100"), ("1.50", "1.5"), ("0", "0"), ("0.00000001", "0.00000001"), ("-2.10", "-2.1")])
def test_number_text(spark, text, want):
    assert one(spark, exact.number_text(F.col("v").cast("decimal(24,8)")), v=text) == want


@pytest.mark.parametrize("value, divisor, want", [("0.00000001", "2", "0"), ("0.00000003", "2", "0.00000002"), ("1", "3", "0.33333333"),
                                                   ("0.00000005", "2", "0.00000002")])
def test_half_even(spark, value, divisor, want):
    got = one(spark, exact.half_even_quotient(F.col("v").cast("decimal(24,8)"), F.col("d").cast("bigint")), v=value, d=divisor)
    assert got == D(want)


@pytest.mark.parametrize("text, want", [
    ("2024-07-02T13:30:00Z", datetime(2024, 7, 2, 13, 30)), ("2024-07-02T09:30:00-04:00", datetime(2024, 7, 2, 13, 30)),
    ("2024-07-02T13:30:00", None), ("2024-07-02 13:30:00Z", None), ("1719927000", None), ("2024-07-02", None), ("2024-13-02T13:30:00Z", None),
])
def test_instants_need_an_offset(spark, text, want):
    assert one(spark, clocks.offset_instant(F.col("v")), v=text) == want


def test_daylight_saving_moves_the_open(spark):
    rows = spark.createDataFrame([(datetime(2024, 11, 1, 13, 30),), (datetime(2024, 11, 5, 0, 30),)], "t timestamp")
    assert [str(r[0]) for r in rows.select(clocks.exchange_date(F.col("t"))).collect()] == ["2024-11-01", "2024-11-04"]
    assert one(spark, clocks.utc_text(F.col("v").cast("timestamp")), v="2024-07-02 13:30:00.5") == "2024-07-02T13:30:00.500000Z"


@pytest.mark.parametrize("text, want", [
    ('{"k": 1}', None), ('{"k": 1, "k": 2}', "duplicate_key"), ('{"k": NaN}', "non_finite_number"), ('{"k": 1', "malformed"),
    ('{"x": "NaN"}', None), ('[1]', "malformed"), ('{"k": -Infinity}', "non_finite_number"),
    ('{"k": {"a": [{"v": 1, "v": 2}]}}', "duplicate_key"), ('{"k": 1} x', "malformed"), ('{"k": 1}{"l": 2}', "malformed"), ('{"k": 1}, {"l": 2}', "malformed"),
    ('{"k": 1.1000000000000000001}', "inexact_number"), ('{"k": "1.1000000000000000001"}', None), ('{"k": 1.10000000000000000000}', None), (None, "malformed"),
])
def test_strict_json(spark, text, want):
    assert one(spark, strict_json_reason(F.col("v")), v=text) == want


SECRET = 'p"w\n9'
LINES = [
    ("api_key=abc next", "api_key=[REDACTED] next"), ("Authorization: Bearer abc def", "Authorization: [REDACTED]"),
    ('{"my_token": "a\\"b", "n": 1}', '{"my_token": [REDACTED], "n": 1}'), ("the tokenizer is harmless", "the tokenizer is harmless"),
    ("known " + SECRET + " here", "known [REDACTED] here"), ("DB_PASSWORD : 'x y'; rest", "DB_PASSWORD : [REDACTED]; rest"),
    ("x\nauthorization=abc token=1\ny", "x\nauthorization=[REDACTED]\ny"),
]


@pytest.mark.parametrize("line, want", LINES)
def test_redaction_is_complete_and_idempotent(spark, line, want):
    once = one(spark, redact(F.col("v"), [SECRET]), v=line)
    assert once == want
    assert one(spark, redact(F.col("v"), [SECRET]), v=once) == want


def test_redaction_does_not_depend_on_the_word_search(spark):
    from asofmill.functions.text import AUTHORIZATION, MASK, SECRET_FIELD

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text")
    plain = F.regexp_replace(F.regexp_replace("text", AUTHORIZATION, "$1" + MASK), SECRET_FIELD, "$1" + MASK)
    assert docs.where(plain != redact(F.col("text"))).count() == 0


def test_identity_ignores_layout_and_sees_changes(spark):
    rows = spark.range(100).select("id", (F.col("id") % 7).cast("decimal(24,8)").alias("v"), F.lit("2024-01-01").cast("date").alias("d"))
    digest = lambda df: identity.table_digest(df).first()["digest"]
    base = digest(rows)
    assert digest(rows.repartition(5).orderBy(F.desc("id"))) == base
    assert digest(rows.where("id <> 3")) != base
    assert digest(rows.withColumn("v", F.when(F.col("id") == 3, 1).otherwise(F.col("v")).cast("decimal(24,8)"))) != base
    assert digest(rows.unionByName(rows.where("id = 3"))) != base


def test_canonical_json_keeps_nulls_and_sorts_keys(spark):
    df = spark.createDataFrame([("b", None)], "b string, a string")
    assert df.select(identity.canonical_json({"b": F.col("b"), "a": F.col("a")})).first()[0] == '{"a":null,"b":"b"}'

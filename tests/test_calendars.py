"""Calendars with repeated, conflicting and no sessions."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from asofmill.functions.text import redact
from asofmill.operators import calendars as K

DAYS = [date(2024, 7, d) for d in (1, 2, 3, 5)]
SCHEMA = "session date, market_open timestamp, market_close timestamp"


def _sessions(spark, days, hour=13):
    return spark.createDataFrame([(d, datetime(d.year, d.month, d.day, hour, 30), datetime(d.year, d.month, d.day, 20)) for d in days], SCHEMA)


def _before(spark, sessions, day):
    row = spark.createDataFrame([(day,)], "day date")
    return K.sessions_before(row, sessions, "day", "n").first()["n"]


def test_repeated_rows_count_once(spark):
    twice = _sessions(spark, DAYS).unionAll(_sessions(spark, DAYS[1:3]))
    assert [_before(spark, twice, d) for d in (date(2024, 6, 1), DAYS[2], DAYS[3], date(2025, 1, 1))] == [0, 2, 3, 4]


def test_two_exchanges_are_refused(spark):
    with pytest.raises(ValueError, match="one exchange"):
        K.calendar_of(_sessions(spark, DAYS).unionAll(_sessions(spark, DAYS[:1], hour=14)))


def test_an_empty_calendar_answers(spark):
    none = _sessions(spark, DAYS).limit(0)
    assert _before(spark, none, DAYS[0]) == 0
    request = spark.createDataFrame(
        [(1, DAYS[0], DAYS[3], DAYS[1], 0, datetime(2024, 8, 1), date(2020, 1, 1), None)],
        "request_id int, start_session date, end_session date, first_execution_session date, warmup_sessions int, requested_at timestamp, listed_on date, delisted_on date")
    assert K.request_rejects(request, none).first()["reason"] == "unfinished_range"
    universe = spark.createDataFrame([("A", date(2020, 1, 1), None)], "symbol string, listed_on date, delisted_on date")
    bars = spark.createDataFrame([], "symbol string, session date")
    assert K.missing_sessions(universe, bars, none).count() == 0


def test_known_values_in_every_spelling(spark):
    secret = 'a"b\'c\\d\n'
    spelled = [secret, '"a\\"b\'c\\\\d\\n"', "'a\"b\\'c\\\\d\\n'"]
    rows = spark.createDataFrame([(f"x {s} y",) for s in spelled] + [("ab abc",)], "v string")
    found = [r[0] for r in rows.select(redact(F.col("v"), [secret, "ab", "abc"])).collect()]
    assert found == ["x [REDACTED] y", 'x "[REDACTED]" y', "x '[REDACTED]' y", "[REDACTED] [REDACTED]"]

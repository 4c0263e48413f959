"""Canonical JSON against Python's own reader and writer, and the gates that use it."""

import hashlib
import json
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from asofmill.functions import wire as W
from asofmill.operators import bars as B
from asofmill.operators import capture as C
from asofmill.schemas import ACTIONS, require

from . import fixtures as T

TEXTS = [
    '{}', '[]', '{"b":1,"a":2}', ' { "b" : [ 1 , 2.50, {"z":null,"y":true,"x":false} ] , "a" : "x y" } ', '{"a":{"b":{"d":1,"c":[{"f":1,"e":2}]}}}',
    '[1.0,1.50,0.0,0.00,-0.0,1e2,1E+2,1.0e-7,0.000001,0.0000001,123.456e3,-12.5e-10,1e0,100.0e1,0e5,0.0e3]',
    '[0,-0,-5,123456789012345678,1234567890123456789,12345678901234567890123456789012345678901234567890]',
    '[0.12345678901234567890123,99999999999999999999.99999999999999999999]',
    '{"é":1,"Z":2,"a":3,"_":4,"#":5,"#x":6,"~":7}', '["é漢𝒳\\u00e9\\ud835\\udcb3"," \\u0000\\u0001\\u000b\\u001f\\u007f\\n\\r\\t\\b\\f","\\/ / \\\\ \\" \\\\u00e9"]',
    '["#f1.5","#i5","##","#","\\u0023f2","x\\"#i5","\\\\","a#f1"]', '{"#i7":"#f7","k":"1.5","n":1.5,"s":"-3e4 1.0"}', '[["-","1-2","--"],-1,-1.5]', '"text"', '1.5', 'null',
]
BROKEN = ['', 'nonsense', '{"a":1', '{"a":1,"a":2}', '{"a":{"b":1,"b":2}}', "{'a':1}", '[1,]']


def plain(text):
    return json.dumps(json.loads(text, parse_float=Decimal), sort_keys=True, separators=(",", ":"), default=str)


def test_canonical_texts(spark):
    rows = spark.createDataFrame([(n, t) for n, t in enumerate(TEXTS + BROKEN)], "n int, text string")
    got = {r["n"]: (r["form"], r["digest"]) for r in rows.select("n", W.canonical_text(F.col("text")).alias("form"), W.wire_hash(F.col("text")).alias("digest")).collect()}
    for n, text in enumerate(TEXTS):
        assert got[n] == (plain(text), hashlib.sha256(plain(text).encode()).hexdigest()), text
    assert all(got[n] == (None, None) for n in range(len(TEXTS), len(TEXTS + BROKEN)))


NUMBERS = [
    ("10000000000000000001e-19", True), ("5e-19", True), ("1e2", False), ("0.1234567890123456789", True), ("0.1234567890123456780", False), ("1.5e-17", False),
    ("1.5e-18", True), ("10e-19", False), ("0e-30", False), ("0.0000000000000000000000", False), ("12345678901234567890", False), ("-5E-19", True), ("1.0000000000000000001", True),
]


@pytest.mark.parametrize("number, lost", NUMBERS)
def test_numbers_are_judged_by_value(spark, number, lost):
    page = spark.createDataFrame([("/v2/stocks/bars", f'{{"bars": {{"X": [{{"o": {number}, "t": "5e-19"}}]}}, "next_page_token": null}}')], "path string, body string")
    assert C.page_rejects(page).first()["reason"] == ("invalid_response" if lost else None)


SPLIT = '{"id":"1","symbol":"BBTEST","new_rate":2,"old_rate":1,"process_date":"2024-06-20","ex_date":"2024-07-03"%s}'


def _page(rows, seq=0):
    return ("capture", seq, C.ACTIONS_PATH, datetime(2024, 8, 2), f'{{"corporate_actions":{{"forward_splits":[{rows}]}},"next_page_token":null}}')


def _judge(spark, pages, operator):
    frame = spark.createDataFrame(pages, "capture_id string, seq long, path string, received_at timestamp, body string")
    scope = (T.sessions(spark), T.universe(spark), F.lit(date(2024, 7, 1)), F.lit(date(2024, 7, 9)))
    return C.action_verdicts(frame, *scope) if operator == "verdicts" else C.classify_actions(C.action_rows(frame), *scope)


def test_revision_of_an_action_is_the_digest_of_all_its_fields(spark):
    """Fields that no type of ours names count, their order does not."""
    texts = [SPLIT % ',"extra":{"b":1.10,"a":[1,2]}', SPLIT % ', "extra": {"a":[1, 2],"b":1.10}', SPLIT % ',"extra":{"b":1.1,"a":[1,2]}', SPLIT % ""]
    found = []
    for text in texts:
        rows = C.corporate_actions(_judge(spark, [_page(text)], "actions"))
        found += [r["revision_id"] for r in require(rows, ACTIONS).collect()]
    assert found == [hashlib.sha256(plain(t).encode()).hexdigest() for t in texts]
    assert found[0] == found[1] and len(set(found)) == 3


def test_every_action_page_is_accounted_for(spark):
    whole, other = SPLIT % "", (SPLIT % "").replace('"1"', '"2"')
    pages = [_page(whole), _page(f"{other},{whole}", 1), ("capture", 2, C.ACTIONS_PATH, datetime(2024, 8, 2), _page(whole)[4][:-5]), _page("7", 3), _page("", 4), _page(None, 5)]
    got = sorted((r["seq"], r["pos"] if r["pos"] is not None else -1, r["action_id"], r["status"]) for r in _judge(spark, pages, "verdicts").collect())
    assert got == [(0, 0, "1", "accepted"), (1, 0, "2", "accepted"), (1, 1, "1", "duplicate_action"), (2, -1, None, "invalid_response"), (3, -1, None, "invalid_response"),
                   (4, -1, None, None), (5, -1, None, "invalid_response")]


def test_incomplete_sessions_stand_beside_bars(spark):
    sessions = T.sessions(spark, T.DAYS[:2])
    opened = T.at(T.DAYS[0], 13, 30)
    short = sessions.withColumn("market_close", F.col("market_open") + F.expr("INTERVAL 2 MINUTES"))
    rows = [("BBTEST", opened.replace(minute=m), T.D(1), T.D(3), T.D(1), T.D(2), 5, T.INGESTED) for m in (30, 31)] + [("OTHER", opened, T.D(1), T.D(1), T.D(1), T.D(1), 1, T.INGESTED)]
    minutes = spark.createDataFrame(rows, "symbol string, t timestamp, o decimal(24,8), h decimal(24,8), l decimal(24,8), c decimal(24,8), v long, received_at timestamp")
    got = B.judged_bars(minutes, short, "p", "f", "synthetic", T.universe(spark)).collect()
    assert {(r["symbol"], r["session"]): (r["observed_minutes"], r["expected_minutes"], r["reason"], r["revision_id"] is not None) for r in got} == {
        ("BBTEST", T.DAYS[0]): (2, 2, None, True), ("OTHER", T.DAYS[0]): (1, 2, "missing_minutes", True), ("BBTEST", T.DAYS[1]): (0, 2, "missing_minutes", False)}
    assert [r["symbol"] for r in B.regular_bars(minutes, short, "p", "f", "synthetic").collect()] == ["BBTEST"]

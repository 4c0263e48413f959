"""Faults in captured pages."""

import copy
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from asofmill.operators import bars as B
from asofmill.operators import capture as C

from . import fixtures as T


def _judge(spark, pages):
    universe = T.universe(spark).unionByName(T.universe(spark, "ZZTEST"))
    return C.classify_minutes(C.minute_rows(T.pages_frame(spark, pages)), T.sessions(spark, T.DAYS[1:3]), universe)


def _edit(change):
    pages = copy.deepcopy(T.bar_pages())
    change(pages)
    return pages


def _row(pages, page=0, symbol="BBTEST", at=5):
    return pages[page][3][symbol][at]


MINUTE_FAULTS = {
    "unexpected_symbol": lambda p: p[0][3].update(OTHER=[dict(_row(p))]),
    "invalid_bar": lambda p: _row(p).pop("c"),
    "invalid_volume": lambda p: _row(p).update(v=1.5),
    "invalid_minute": lambda p: _row(p).update(h=1),
    "duplicate_or_unordered_bar": lambda p: p[0][3]["BBTEST"].insert(6, dict(_row(p))),
    "outside_session": lambda p: _row(p, at=0).update(t="2024-07-02T13:29:00Z"),
}


@pytest.mark.parametrize("code", MINUTE_FAULTS)
def test_minute_faults(spark, code):
    judged = _judge(spark, _edit(MINUTE_FAULTS[code]))
    assert {r[0] for r in judged.select("reject_reason").distinct().collect()} == {None, code}
    assert judged.where(F.col("reject_reason").isNotNull()).count() == 1


@pytest.mark.parametrize("change", [lambda r: r.update(t="2024-07-02T13:35:30Z"), lambda r: r.update(t="2024-07-02T13:35:00"),
                                    lambda r: r.update(o=0), lambda r: r.update(v=-1), lambda r: r.update(c=105.123456789)])
def test_invalid_minutes(spark, change):
    judged = _judge(spark, _edit(lambda p: change(_row(p))))
    assert [r[0] for r in judged.where("reject_reason is not null").select("reject_reason").collect()] == ["invalid_minute"]


def test_swapped_rows_are_unordered_across_pages(spark):
    def swap(pages):
        first, last = pages[0][3]["ZZTEST"], pages[1][3]["ZZTEST"]
        first[-1], last[0] = last[0], first[-1]

    judged = _judge(spark, _edit(swap))
    assert {r[0] for r in judged.where("reject_reason is not null").select("reject_reason").collect()} == {"duplicate_or_unordered_bar"}


def test_incomplete_session_gives_no_bar(spark):
    pages = _edit(lambda p: p[0][3]["BBTEST"].pop(7))
    judged = _judge(spark, pages)
    sessions = T.sessions(spark, T.DAYS[1:3])
    accepted = judged.where("reject_reason is null").drop("session")
    assert B.regular_bars(accepted, sessions, "p", "sip", "synthetic").count() == 3
    gaps = B.minute_completeness(accepted.select("symbol", "t"), sessions, T.universe(spark)).where("missing_minutes > 0").collect()
    assert [(r["symbol"], r["missing_minutes"], r["first_missing"]) for r in gaps] == [("BBTEST", 1, datetime(2024, 7, 2, 13, 37))]


PAGES = [
    ('{"bars": {"X": [{"t": 1}]}, "next_page_token": null}', None), ('{"bars": {}, "next_page_token": null}', None),
    ('{"bars": null, "next_page_token": null}', None), ('{"bars": {"X": [{"t": 1}]}, "next_page_token": "t"}', None),
    ('{"bars": {"X": []}, "next_page_token": "t"}', "empty_page"), ('{"bars": {}}', "incomplete_response"),
    ('{"next_page_token": null}', "incomplete_response"), ('{"bars": [], "next_page_token": null}', "invalid_response"),
    ('{"bars": {"X": 1}, "next_page_token": null}', "invalid_response"), ("nonsense", "invalid_response"),
    ('{"bars": {"X": [{"t": 1}]}, "next_page_token": 7}', "invalid_pagination"), ('{"bars": {"X": [{"t": 1}]}, "next_page_token": ""}', "invalid_pagination"),
    ('{"bars": {"X": [5, {"t": 1}]}, "next_page_token": null}', "invalid_response"), ('{"bars": {"X": [{"t": 1}]}, "next_page_token": null', "invalid_response"),
    ('{"bars": {"X": [{"v": 1, "v": 2}]}, "next_page_token": null}', "invalid_response"), ('{"bars": {}, "next_page_token": null} {}', "invalid_response"),
    ('{"bars": {"X": [{"o": 1.10000000000000000001}]}, "next_page_token": null}', "invalid_response"), (None, "invalid_response"),
    ('{"bars": {"X": [null]}, "next_page_token": null}', "invalid_response"),
]


@pytest.mark.parametrize("body, reason", PAGES)
def test_page_shape(spark, body, reason):
    page = spark.createDataFrame([("/v2/stocks/bars", body)], "path string, body string")
    assert C.page_rejects(page).first()["reason"] == reason


SPLIT = dict(id="1", symbol="BBTEST", new_rate=2, old_rate=1, process_date="2024-06-20", ex_date="2024-07-03")
DIVIDEND = dict(id="2", symbol="BBTEST", rate=0.5, special=False, foreign=False, process_date="2024-08-01", ex_date="2024-07-05",
                payable_date="2024-07-09")


def _statuses(spark, body):
    page = [[0, "2024-07-01T00:00:00Z", datetime(2024, 8, 2), body, None]]
    rows = C.action_rows(T.pages_frame(spark, page, "/v1/corporate-actions", "corporate_actions"))
    return C.classify_actions(rows, T.sessions(spark), T.universe(spark), F.lit(date(2024, 7, 1)), F.lit(date(2024, 7, 9)))


def test_actions_by_economic_date(spark):
    judged = _statuses(spark, {"forward_splits": [SPLIT], "cash_dividends": [DIVIDEND]})
    rows = C.corporate_actions(judged).collect()
    assert [(r["kind"], r["effective_session"], r["split_ratio"], r["cash_amount_usd"], r["pay_date"]) for r in rows] == [
        ("split", date(2024, 7, 3), 2, None, None), ("cash_dividend", date(2024, 7, 5), None, T.D("0.5"), date(2024, 7, 9))]
    assert rows[0]["available_at"] == datetime(2024, 7, 3, 13, 30)


ACTION_FAULTS = [
    ("forward_splits", SPLIT, dict(new_rate=3, old_rate=2), "unsupported_split"), ("forward_splits", SPLIT, dict(new_rate=1), "unsupported_split"),
    ("forward_splits", SPLIT, dict(due_bill_redemption_date="2024-07-09"), "unsupported_split"),
    ("forward_splits", SPLIT, dict(ex_date=None), "incomplete_actions"), ("forward_splits", SPLIT, dict(id=""), "invalid_action"),
    ("forward_splits", SPLIT, dict(symbol="OTHER"), "action_scope"), ("forward_splits", SPLIT, dict(ex_date="2024-07-04"), "action_scope"),
    ("forward_splits", SPLIT, dict(ex_date="2024-08-01"), "ignored"), ("reverse_splits", SPLIT, {}, "unsupported_action"),
    ("reverse_splits", SPLIT, dict(ex_date="2024-08-01", process_date="2024-08-01"), "ignored"),
    ("reverse_splits", SPLIT, dict(ex_date="2024-08-01", process_date="2024-07-01"), "unsupported_action"),
    ("cash_dividends", DIVIDEND, dict(special=True), "unsupported_dividend"), ("cash_dividends", DIVIDEND, dict(foreign=None), "unsupported_dividend"),
    ("cash_dividends", DIVIDEND, dict(due_bill_on_date="2024-07-01"), "unsupported_dividend"),
    ("cash_dividends", DIVIDEND, dict(payable_date="2024-07-01"), "invalid_action"),
]


def test_action_faults(spark):
    # One capture for all cases: every case gets an id of its own.
    body = {}
    for n, (kind, base, change, _) in enumerate(ACTION_FAULTS):
        record = {**base, "id": str(100 + n), **change}
        body.setdefault(kind, []).append({k: v for k, v in record.items() if v is not None})
    found = {r["action_id"]: r["status"] for r in _statuses(spark, body).collect()}
    want = {"" if change.get("id") == "" else str(100 + n): status for n, (_, _, change, status) in enumerate(ACTION_FAULTS)}
    assert found == want


def test_repeated_action_id(spark):
    judged = _statuses(spark, {"forward_splits": [SPLIT, dict(SPLIT, ex_date="2024-07-05")]})
    assert [r["status"] for r in judged.orderBy("pos").collect()] == ["accepted", "duplicate_action"]


def test_page_completeness(spark):
    columns = "capture_id string, seq bigint, path string"
    pages = spark.createDataFrame([("c", 0, "a"), ("c", 1, "x"), ("c", 3, "d")], columns)
    expected = spark.createDataFrame([("c", 0, "a"), ("c", 1, "b"), ("c", 2, "c")], columns)
    found = C.page_completeness(pages, expected, ["capture_id", "seq"], ["path"])
    assert [r["status"] for r in found.orderBy("seq").collect()] == [
        "ok", "capture_request_mismatch", "incomplete_capture", "extra_capture_pages"]


def test_every_page_is_accounted_for(spark):
    bodies = [b for b, _ in PAGES]
    pages = spark.createDataFrame([("c", n, C.BARS_PATH, {"start": "2024-07-01T13:30:00Z"}, datetime(2024, 8, 2), b) for n, b in enumerate(bodies)],
                                  "capture_id string, seq bigint, path string, params map<string,string>, received_at timestamp, body string")
    found = C.capture_verdicts(pages, T.sessions(spark), T.universe(spark)).collect()
    assert {r["seq"] for r in found} == set(range(len(bodies)))
    for n, (_, reason) in enumerate(PAGES):
        if reason:
            assert [r["reason"] for r in found if r["seq"] == n] == [reason]


def test_a_page_body_is_read_once_for_all_rules(spark):
    pages = spark.createDataFrame([("/v2/stocks/bars", "{}")], "path string, body string")
    plan = C.page_rejects(pages)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("get_json_object") <= 5 and plan.count("from_json") <= 1

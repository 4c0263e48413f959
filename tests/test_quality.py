"""One fault at a time in an otherwise valid dataset."""

from datetime import date, timedelta

import pytest

from asofmill.functions.rules import violations
from asofmill.operators import quality as Q
from asofmill.operators import records

from . import fixtures as T

OTHER = date(2024, 7, 4)


def _bars(change=None, drop=None, **values):
    rows = T.bar_rows()
    if change is not None:
        rows[change].update(values)
    if drop is not None:
        del rows[drop]
    return rows


def _actions(index=None, **values):
    rows = T.action_rows()
    if index is not None:
        rows[index].update(values)
    return rows


def _swapped():
    rows = T.bar_rows()
    rows[0]["arrival"], rows[1]["arrival"] = 1, 0
    return rows


def _doubled():
    return T.bar_rows() + [dict(T.bar_rows()[5], arrival=6)]


CASES = {
    "valid": ({}, {}, {}, set()),
    "missing": (dict(rows=_bars(drop=3)), {}, {}, {"missing_bars"}),
    "gap": (dict(rows=_bars(4, open=T.D(80), high=T.D(84), low=T.D(79), close=T.D(81))), {}, {}, {"large_opening_gap"}),
    "zero volume": (dict(rows=_bars(4, volume=0)), {}, {}, {"zero_volume"}),
    "unknown actions": ({}, {}, dict(corporate_actions_coverage="unknown"), {"incomplete_actions"}),
    "provenance": (dict(rows=_bars(2, feed="other")), {}, {}, {"bar_provenance"}),
    "order": (dict(rows=_swapped()), {}, {}, {"bar_order_or_duplicate"}),
    "copy": (dict(rows=_doubled()), {}, {}, {"bar_order_or_duplicate"}),
    "closure": (dict(rows=_bars(3, session=OTHER)), {}, {}, {"unknown_session", "missing_bars"}),
    "hours": (dict(rows=_bars(2, interval_end=T.at(T.DAYS[2], 20))), {}, {}, {"session_hours"}),
    "ingested late": (dict(rows=_bars(1, first_ingested_at=T.INGESTED + timedelta(days=1))), {}, {}, {"retrieval_timing"}),
    "unlisted": (dict(rows=_bars(1, symbol="OTHER")), {}, {}, {"unlisted_bar", "missing_bars", "bar_order_or_duplicate"}),
    "action off session": ({}, dict(rows=_actions(0, effective_session=OTHER)), {}, {"action_session", "large_opening_gap"}),
    "action late": ({}, dict(rows=_actions(1, first_ingested_at=T.INGESTED + timedelta(days=1))), {}, {"action_retrieval_timing"}),
    "action ids": ({}, dict(rows=_actions(1, action_id="split-1")), {}, {"action_order_or_duplicate"}),
    "warmup": ({}, {}, dict(warmup_sessions=9), {"insufficient_warmup"}),
    "execution day": ({}, {}, dict(first_execution_session=OTHER, warmup_sessions=0), {"execution_not_session"}),
    "revisions": ({}, {}, dict(revision_policy="unknown"), {"unknown_revision_timing"}),
}


@pytest.mark.parametrize("name", CASES)
def test_single_fault(spark, name):
    bars, actions, plan, codes = CASES[name]
    report = Q.quality_findings(
        T.plan(**plan), T.universe(spark), T.bars(spark, **bars), T.actions(spark, **actions), T.sessions(spark),
        bar_arrival="arrival", action_arrival="arrival",
    )
    rows = report.collect()
    assert {r["code"] for r in rows} - {"synthetic_data"} == codes
    if name in ("valid", "missing", "gap"):
        assert Q.is_usable(report).first()["usable"] == (name != "missing")


def test_coverage_of_a_listing_interval(spark):
    universe = T.universe(spark, delisted=T.DAYS[4]).unionByName(T.universe(spark, "NEW", T.DAYS[4]))
    rows = {r["symbol"]: r for r in Q.session_coverage(universe, T.bars(spark, _bars(drop=3)), T.sessions(spark)).collect()}
    assert (rows["BBTEST"]["expected_bars"], rows["BBTEST"]["observed_bars"], rows["BBTEST"]["missing_sessions"]) == (4, 5, [T.DAYS[3]])
    assert (rows["NEW"]["expected_bars"], rows["NEW"]["observed_bars"], rows["NEW"]["missing_sessions"]) == (2, 0, T.DAYS[4:])


@pytest.mark.parametrize("change, reason", [
    ({}, None), (dict(open=T.D(200)), "price_order"), (dict(low=T.D(0)), "price_range"), (dict(volume=-1), "volume_range"),
    (dict(available_at=T.at(T.DAYS[0], 19)), "clock_order"), (dict(session=OTHER), "session_date"), (dict(close=None), "price_order"),
])
def test_bar_rules(spark, change, reason):
    found = violations(T.bars(spark, [dict(T.bar_rows()[0], **change)]), ["symbol"], records.bar_rules())
    reasons = {r["reason"] for r in found.collect()}
    assert reasons == set() if reason is None else reason in reasons


def test_plan_faults():
    assert T.plan().faults() == []
    assert T.plan(limitations=()).faults() == ["synthetic_limitation"]
    assert T.plan(revision_policy="unknown").faults() == ["revision_limitation"]
    assert T.plan(first_execution_session=date(2024, 8, 1)).faults() == ["date_order"]

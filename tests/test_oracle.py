"""Every registered query against its oracle statement."""

import pytest

import __spark_entry__ as entry
from asofmill import plans

from .compare import compare, connect

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = plans.queries(), plans.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    assert name in ORACLES
    assert compare(spark, duck, QUERIES[name], ORACLES[name], FOLDER) == ""


def test_entry_registers_all_of_them():
    assert QUERIES.keys() <= entry.queries().keys() and ORACLES.keys() <= entry.oracle_sql().keys() <= entry.queries().keys()


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_no_cross_join_in_any_plan(spark, capsys):
    for name in ("daily_bars", "ledger_replay", "eligible_context", "minute_rejects", "session_coverage", "evidence_spans", "capture_rejects"):
        QUERIES[name](spark, FOLDER).explain()
        text = capsys.readouterr().out
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name

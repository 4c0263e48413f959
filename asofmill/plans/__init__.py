"""All registered queries."""

from __future__ import annotations

from . import accounts, captures, faults, ingest, jobs, market, policy, research, streams, texts  # noqa: F401
from .registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)

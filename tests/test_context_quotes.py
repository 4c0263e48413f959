"""Assessments of a decision against the documents of the same decision."""

import hashlib
from datetime import datetime

from asofmill.operators import context as X
from asofmill.functions.rules import violations
from pyspark.sql import functions as F

TEXT = "Rates were left as they are. Größere Sorgen gibt es nicht."
HASH = hashlib.sha256(TEXT.encode()).hexdigest()
EARLY, LATE = datetime(2024, 1, 1), datetime(2024, 3, 1)


def test_quotes_hold_within_their_own_decision(spark):
    documents = spark.createDataFrame(
        [(1, "d", HASH, TEXT, EARLY), (2, "d", HASH, TEXT, LATE), (2, "e", HASH, TEXT, EARLY)],
        "context_id long, document_id string, content_sha256 string, original_text string, available_at timestamp")
    macro = spark.createDataFrame([(1, 10, datetime(2024, 2, 1)), (2, 20, datetime(2024, 2, 1)), (3, 30, datetime(2024, 2, 1))],
                                  "context_id long, assessment_id long, source_cutoff timestamp")
    quotes = spark.createDataFrame(
        [(1, 10, "d", HASH, 0, 5, "Rates"), (1, 10, "e", HASH, 0, 5, "Rates"), (2, 20, "d", HASH, 29, 36, "Größere"), (2, 20, "e", HASH, 0, 5, "rates"),
         (2, 20, "e", "0" * 64, 0, 5, "Rates"), (2, 20, "e", HASH, 0, 5, "rates")],
        "context_id long, assessment_id long, document_id string, content_sha256 string, start int, end int, text string")
    got = sorted(tuple(r) for r in X.unsupported_quotes(macro, quotes, documents).collect())
    assert got == [(1, "10", "macro_quote_missing_document"), (2, "20", "macro_quote_content_hash"), (2, "20", "macro_quote_span_text"),
                   (2, "20", "macro_source_late")]


def test_repeated_dataset_ids(spark):
    at = datetime(2024, 1, 2, 15)
    rows = [(n, "backtest", EARLY, at, LATE, at.date(), EARLY, EARLY, EARLY, ids) for n, ids in ((1, ["a", "b"]), (2, ["a", "a"]))]
    contexts = spark.createDataFrame(rows, "context_id long, mode string, decision_at timestamp, execution_at timestamp, target_expires_at timestamp, "
                                     "execution_session date, portfolio_as_of timestamp, model_trained_through timestamp, model_created_at timestamp, dataset_ids array<string>")
    found = violations(contexts, ["context_id"], X.context_rules()).where(F.col("reason") == "duplicate_dataset_id").collect()
    assert [r.context_id for r in found] == [2]

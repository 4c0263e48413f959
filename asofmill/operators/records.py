"""Declarative rules of single records. Each function returns (code, broken) pairs for ``functions.rules``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.clocks import exchange_date
from ..functions.rules import Rule, no


def bar_rules() -> list[Rule]:
    c = F.col
    clocks = (c("interval_start") < c("interval_end")) & (c("interval_end") <= c("available_at")) & (
        c("available_at") <= c("first_ingested_at")
    )
    # Compared one by one: least and greatest pass over nulls.
    prices = F.lit(True)
    for name in ("open", "close"):
        prices = prices & (c("low") <= c(name)) & (c(name) <= c("high"))
    same_day = (exchange_date(c("interval_start")) == c("session")) & (exchange_date(c("interval_end")) == c("session"))
    return [
        ("clock_order", no(clocks)), ("session_date", no(same_day)), ("price_order", no(prices)),
        ("price_range", no((c("open") > 0) & (c("high") > 0) & (c("low") > 0) & (c("close") > 0))), ("volume_range", no(c("volume") >= 0)),
    ]


def instrument_rules() -> list[Rule]:
    c = F.col
    return [("listing_order", c("delisted_on") <= c("listed_on")), ("symbol", ~R.matches(c("symbol"), R.SYMBOL))]


def feature_rules() -> list[Rule]:
    c = F.col
    return [
        ("duplicate_feature_name", R.has_duplicates(F.transform("values", lambda v: v["name"]))),
        ("clock_order", no(c("available_at") <= c("computed_at")) | (c("adjusted_as_of") > c("computed_at"))),
        ("session_after_availability", no(c("session") <= exchange_date(c("available_at")))),
    ]


def action_rules() -> list[Rule]:
    c = F.col
    split = c("split_ratio").isNotNull() & c("cash_amount_usd").isNull() & c("pay_date").isNull() & (c("split_ratio") >= 2)
    dividend = (
        c("split_ratio").isNull() & c("cash_amount_usd").isNotNull() & (c("cash_amount_usd") > 0)
        & c("pay_date").isNotNull() & (c("pay_date") >= c("effective_session"))
    )
    return [
        ("clock_order", no(c("available_at") <= c("first_ingested_at"))),
        ("unknown_kind", no(c("kind").isin("split", "cash_dividend"))),
        ("split_fields", (c("kind") == "split") & no(split)),
        ("dividend_fields", (c("kind") == "cash_dividend") & no(dividend)),
    ]


def span_rules() -> list[Rule]:
    return [("span_length", (F.col("end") - F.col("start")) != F.length("text"))]


def model_rules() -> list[Rule]:
    """Strategy rows with an optional numerical model."""
    c = F.col
    return [
        ("duplicate_feature_name", R.has_duplicates(c("feature_names"))),
        ("duplicate_parameter", R.has_duplicates(c("parameter_names"))),
        ("training_order", c("trained_through") > c("created_at")),
        ("feature_schema", c("model_schema_id").isNotNull() & R.differs(c("model_schema_id"), c("feature_schema_id"))),
        ("feature_order", c("model_feature_names").isNotNull() & R.differs(c("model_feature_names"), c("feature_names"))),
    ]


def request_rules(first_supported: str = "2016-01-01") -> list[Rule]:
    """Date bounds of a history request. The local limits on symbols, days and pages do not apply here."""
    c = F.col
    ordered = (F.lit(first_supported).cast("date") <= c("start_session")) & (
        c("start_session") <= c("first_execution_session")
    ) & (c("first_execution_session") <= c("end_session"))
    return [("date_order", no(ordered))]


def plan_rules() -> list[Rule]:
    """The rules of a dataset plan kept as a table row."""
    c = F.col
    tags = c("limitations")
    synthetic = F.array_contains(tags, F.lit("synthetic_data"))
    return [
        ("duplicate_limitations", R.has_duplicates(tags)),
        ("date_order", no((c("coverage_start") <= c("first_execution_session"))
                          & (c("first_execution_session") <= c("coverage_end")))),
        ("revision_limitation", (c("revision_policy") == "unknown")
         & ~F.array_contains(tags, F.lit("unknown_revision_timing"))),
        ("synthetic_limitation", (c("origin") == "synthetic") != synthetic),
    ]


def dataset_rules() -> list[Rule]:
    """A dataset reference: the schema follows from the kind."""
    c = F.col
    # Schema per dataset kind.
    expected = (
        F.when(c("kind") == "market", "market_observation.v1").when(c("kind") == "documents", "source_document.v1")
        .when(c("kind") == "macro_assessments", "macro_assessment.v1")
    )
    return [
        ("schema_for_kind", R.differs(c("schema_id"), expected)),
        ("revision_limitation", (c("revision_policy") == "unknown")
         & ~F.array_contains(c("limitations"), F.lit("unknown_revision_timing"))),
    ]


def manifest_rules() -> list[Rule]:
    """Exactly the three data files in order, quality usable and of the same origin, id equal to the content hash."""
    c = F.col
    # The files of a dataset version.
    names = F.array(*[F.lit(n) for n in ("bars.parquet", "actions.parquet", "sessions.parquet")])
    return [
        ("file_list", R.differs(c("file_names"), names)),
        ("quality", no(c("usable")) | R.differs(c("quality_origin"), c("origin"))),
        ("identity", R.differs(c("dataset_id"), c("content_sha256"))),
    ]

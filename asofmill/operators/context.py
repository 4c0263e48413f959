"""Eligibility of everything a decision may look at. A decision's context is a set of tables keyed by
``context_id``, never one nested row.

Everything a decision may look at, its instruments included, is dealt once by ``context_id``. There the rules that need the decision
become bits of one number, only narrow rows are sorted, and running frames over that one order tell whether a symbol belongs to the
universe, which raw observation stands behind a feature and what occurs twice. No frame holds more than one row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clocks import exchange_date
from ..functions.rules import Rule, all_reasons, differs, has_duplicates, no, violations, yes
from .calendars import is_listed
from .documents import verify_quotes
from .portfolio import outside_universe


def context_rules() -> list[Rule]:
    c = F.col
    return [
        ("clock_order", no((c("decision_at") < c("execution_at")) & (c("execution_at") < c("target_expires_at")))),
        ("execution_date", differs(exchange_date(c("execution_at")), c("execution_session"))),
        ("portfolio_after_decision", c("portfolio_as_of") > c("decision_at")),
        ("model_cutoff", (c("model_trained_through") >= c("decision_at"))
         | ((c("mode") != "backtest") & (c("model_created_at") > c("decision_at")))),
        ("duplicate_dataset_id", has_duplicates(c("dataset_ids"))),
    ]


# Kinds in the order in which rows of one symbol are looked at.
_KINDS = ("instrument", "observation", "feature", "document", "macro", "context")
# The columns every kind of item brings to the one pass that judges them all.
_ITEM = (
    "context_id", "kind", "reference", "symbol", "session", "dataset_id", "available_at", "first_ingested_at", "origin",
    "computed_at", "adjusted_as_of", "feature_schema_id", "names", "source_cutoff", "expires_at", "generated_at", "use",
    "listed_on", "delisted_on", "code",
)


def context_items(
    contexts: DataFrame, universe: DataFrame, observations: DataFrame, features: DataFrame | None = None,
    documents: DataFrame | None = None, macro: DataFrame | None = None,
) -> DataFrame:
    """Instruments, observations, features, documents, assessments and what a decision itself breaks (``code``) as rows of one table;
    columns a kind lacks are null."""
    own = violations(contexts, ["context_id"], context_rules(), "code")
    instruments = universe.select("context_id", "symbol", "listed_on", "delisted_on")
    parts = [(observations, "observation", None), (features, "feature", None), (documents, "document", "document_id"),
             (macro, "macro", "assessment_id"), (instruments, "instrument", None), (own, "context", None)]
    items = None
    for df, kind, reference in parts:
        if df is None:
            continue
        named = df.withColumn("kind", F.lit(_KINDS.index(kind)).cast("tinyint"))
        named = named.withColumn("reference", F.col(reference).cast("string")) if reference else named
        named = named.select(*[n for n in _ITEM if n in named.columns])
        items = named if items is None else items.unionByName(named, allowMissingColumns=True)
    for name in _ITEM:
        if name not in items.columns:
            items = items.withColumn(name, F.lit(None).cast("array<string>" if name == "names" else "string"))
    return items


def _kind(*names: str) -> Column:
    return F.col("kind").isin(*[_KINDS.index(name) for name in names])


def item_rules() -> list[Rule]:
    """What a decision must not use. ``d_`` columns are those of the decision."""
    c = F.col
    kind = _kind
    rows = kind("observation", "feature")
    backtest = c("d_mode") == "backtest"
    # Required properties: a missing id or clock breaks them.
    undeclared = no(F.array_contains("d_datasets", c("dataset_id")))
    late = no(c("available_at") <= c("d_decision"))
    ingested_late = ~backtest & no(c("first_ingested_at") <= c("d_decision"))
    return [
        ("undeclared", rows & undeclared),
        ("not_yet_available", rows & (late | (c("session") >= c("d_execution")))),
        ("ingested_after_decision", kind("observation") & ingested_late),
        ("synthetic_outside_backtest", kind("observation") & ~backtest & (c("origin") == "synthetic")),
        ("adjusted_after_decision", kind("feature") & (c("adjusted_as_of") > c("d_decision"))),
        ("computed_after_decision", kind("feature") & ~backtest & (c("computed_at") > c("d_decision"))),
        ("feature_schema", kind("feature") & differs(c("feature_schema_id"), c("d_schema"))),
        ("feature_names", kind("feature") & differs(c("names"), c("d_names"))),
        ("document_not_eligible", kind("document") & (undeclared | late)),
        ("document_ingested_after_decision", kind("document") & ingested_late),
        ("macro_undeclared", kind("macro") & undeclared),
        ("macro_future_or_expired", kind("macro")
         & ~((c("source_cutoff") <= c("d_decision")) & (c("d_decision") < c("expires_at")))),
        ("macro_not_prospective", kind("macro") & ~backtest
         & ((c("use") != "prospective") | (c("generated_at") > c("d_decision")))),
        ("macro_not_exploratory", kind("macro") & backtest & (c("use") != "historical_exploratory")),
        ("execution_outside_listing", kind("instrument") & ~is_listed(c("d_execution"), c("listed_on"), c("delisted_on"))),
    ]


def _judged(contexts: DataFrame, items: DataFrame, rules: list[Rule]) -> DataFrame:
    """Items with the rules they break as bits of ``broken``, and nothing that only those rules need.

    ``found`` says whether the decision is known. An item of a decision that is given twice is two rows, one of them ``first``.
    """
    decisions = contexts.select(
        "context_id", F.col("mode").alias("d_mode"), F.col("decision_at").alias("d_decision"),
        F.col("execution_session").alias("d_execution"), F.col("dataset_ids").alias("d_datasets"),
        F.col("feature_schema_id").alias("d_schema"), F.col("feature_names").alias("d_names"),
        (F.row_number().over(Window.partitionBy("context_id").orderBy("decision_at")) == 1).alias("d_first"),
    )
    found = F.col("d_first").isNotNull()
    bits = [F.when(yes(broken) & found, F.lit(1 << n)).otherwise(F.lit(0)) for n, (_, broken) in enumerate(rules)]
    raw = lambda name: F.when(_kind("observation"), F.col(name))
    feature = lambda name: F.when(_kind("feature"), F.col(name))
    return items.join(decisions, "context_id", "left").select(
        "context_id", "kind", "symbol", "session", "reference", "dataset_id", "code", found.alias("found"),
        F.coalesce("d_first", F.lit(True)).alias("first"), reduce(lambda a, b: a.bitwiseOR(b), bits).alias("broken"),
        raw("available_at").alias("raw_available"), raw("first_ingested_at").alias("raw_ingested"),
        feature("available_at").alias("own_available"), feature("computed_at").alias("own_computed"),
    )


def item_violations(contexts: DataFrame, items: DataFrame) -> DataFrame:
    """Every broken rule of every item as (context_id, item, reason)."""
    c, rules = F.col, item_rules()
    # Rows of a symbol have no reference and the others no symbol, so the order is that of either. Instruments have neither session nor
    # dataset and stand before the rows of their symbol, observations before the features of their dataset.
    of_symbol = F.when(c("kind") <= _KINDS.index("feature"), 0).otherwise(1).alias("side")
    rows = _judged(contexts, items, rules).select("*", of_symbol)
    order = ["context_id", "side", "symbol", "session", "reference", "dataset_id", "kind"]
    until = lambda keys: Window.partitionBy(*order[:keys]).orderBy(*order[keys:]).rowsBetween(Window.unboundedPreceding, 0)
    listed = F.max(F.when(_kind("instrument"), True)).over(until(3))
    whole = reduce(lambda a, b: a & b, [c(n).isNotNull() for n in ("context_id", "symbol", "session", "dataset_id")])
    support = {name: F.when(whole, F.min(name).over(until(6))) for name in ("raw_available", "raw_ingested")}
    # The row that makes an item occur twice reports it.
    twice = F.lit(False)
    for kind in ("instrument", "observation", "feature", "document"):
        twice = twice | (_kind(kind) & (F.sum(F.when(_kind(kind) & c("first"), 1)).over(until(5)) == 2))
    seen = rows.select("*", (listed & c("context_id").isNotNull() & c("symbol").isNotNull()).alias("listed"), twice.alias("twice"),
                       *[column.alias("of_" + name) for name, column in support.items()])
    bit = lambda n: c("broken").bitwiseAND(F.lit(1 << n)) != 0
    stranger = c("found") & _kind("observation", "feature") & no(c("listed"))
    once = c("first") & _kind("feature")
    reasons: list[Rule] = [(code, bit(n) | stranger if code == "undeclared" else bit(n)) for n, (code, _) in enumerate(rules)]
    reasons += [("duplicate_" + kind, _kind(kind) & c("first") & c("twice")) for kind in ("instrument", "observation", "feature", "document")]
    reasons += [("no_observation", once & (c("of_raw_available").isNull() | yes(c("own_available") < c("of_raw_available")))),
                ("computed_before_ingestion", once & (c("own_computed") < c("of_raw_ingested")))]
    broken = F.when(_kind("context"), F.when(c("first"), F.array("code"))).otherwise(all_reasons(reasons))
    named = F.when(_kind("context"), F.lit("")).when(c("reason") == "execution_outside_listing", c("symbol")).otherwise(
        F.coalesce("reference", F.concat_ws("|", "symbol", c("session").cast("string"))))
    return seen.select("context_id", "kind", "reference", "symbol", "session", F.explode(broken).alias("reason")).select(
        "context_id", named.alias("item"), "reason")


def unsupported_quotes(macro: DataFrame, quotes: DataFrame, documents: DataFrame) -> DataFrame:
    """Assessments whose quotations the documents of the same decision do not bear out, as (context_id, item, reason).

    ``quotes`` has context_id, assessment_id, document_id, content_sha256, start, end, text; ``documents`` also content_sha256 and
    original_text. A document of another decision is missing here. Reasons are ``macro_quote_`` and the verdict of ``verify_quotes``, or
    ``macro_source_late`` for a cited document that became available after the source cutoff. An assessment need not quote anything.
    """
    keys = ["context_id", "document_id"]
    judged = verify_quotes(quotes, documents, keys).where("verdict <> 'ok'").select(
        "context_id", "assessment_id", F.concat(F.lit("macro_quote_"), "verdict").alias("reason"))
    cited = quotes.select(*keys, "assessment_id").join(macro.select("context_id", "assessment_id", "source_cutoff"), ["context_id", "assessment_id"])
    late = cited.join(documents.select(*keys, "available_at"), keys).where(no(F.col("available_at") <= F.col("source_cutoff"))).select(
        "context_id", "assessment_id", F.lit("macro_source_late").alias("reason"))
    return judged.unionByName(late).select(
        "context_id", F.col("assessment_id").cast("string").alias("item"), "reason").distinct()


def eligible_context(
    contexts: DataFrame, universe: DataFrame, observations: DataFrame, features: DataFrame | None = None,
    documents: DataFrame | None = None, macro: DataFrame | None = None, exposure: DataFrame | None = None,
    quotes: DataFrame | None = None,
) -> DataFrame:
    """Every broken rule as (context_id, item, reason); a context without rows here is eligible."""
    report = item_violations(contexts, context_items(contexts, universe, observations, features, documents, macro))
    if quotes is not None:
        report = report.unionByName(unsupported_quotes(macro, quotes, documents))
    if exposure is not None:
        strangers = outside_universe(exposure, universe, ["context_id", "symbol"])
        report = report.unionByName(
            strangers.select("context_id", F.col("symbol").alias("item"), F.lit("exposure_outside_universe").alias("reason")).distinct()
        )
    return report


def generate_targets(eligible: DataFrame, strategy, keys: list[str], schema: str) -> DataFrame:
    """Run a user strategy on each decision's eligible rows. The callable maps a pandas frame to a pandas frame.

    One decision is the unit a strategy is defined on, so its rows have to fit a task; strategies that can be written
    with columns should take and return DataFrames instead.
    """
    return eligible.groupBy(*keys).applyInPandas(strategy, schema)

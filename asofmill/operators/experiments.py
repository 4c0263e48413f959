"""Experiments: consistency of a specification, and of contexts and snapshots with it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clocks import exchange_date
from ..functions.rules import Rule, differs, is_subset, violations, yes


def limitation_gaps(datasets: DataFrame, experiments: DataFrame) -> DataFrame:
    """Datasets whose limitation tags the experiment does not repeat."""
    tags = experiments.select("experiment_id", F.col("limitations").alias("__declared"))
    joined = datasets.join(tags, "experiment_id")
    return joined.where(~is_subset(F.col("limitations"), F.col("__declared"))).drop("__declared")


def dataset_facts(datasets: DataFrame) -> DataFrame:
    """Per experiment: kinds, whether any dataset is synthetic, declared and distinct ids, first limitation gap."""
    return datasets.groupBy("experiment_id").agg(
        F.array_sort(F.collect_set("kind")).alias("kinds"), F.bool_or(F.col("origin") == "synthetic").alias("any_synthetic"),
        F.count(F.lit(1)).alias("declared"), F.countDistinct("dataset_id").alias("distinct_ids"),
    )


def experiment_rules() -> list[Rule]:
    """Rules of an experiment row joined with its dataset facts."""
    c = F.col
    prospective = c("research_use") == "prospective"
    has = lambda kind: yes(F.array_contains("kinds", F.lit(kind)))
    return [
        ("duplicate_dataset", c("declared") != c("distinct_ids")),
        ("date_order", c("start_session") > c("end_session")),
        ("no_market_dataset", ~has("market")),
        ("language_model_datasets", c("has_language_model") & ~(has("documents") & has("macro_assessments"))),
        ("assessments_without_model", has("macro_assessments") & ~c("has_language_model")),
        ("backtest_prospective", (c("mode") == "backtest") & prospective),
        ("live_not_prospective", (c("mode") != "backtest") & ~prospective),
        ("synthetic_use", F.coalesce(c("any_synthetic"), F.lit(False)) != (c("research_use") == "synthetic")),
        ("model_cutoff", exchange_date(c("model_trained_through")) >= c("start_session")),
    ]


def experiment_violations(experiments: DataFrame, datasets: DataFrame, universe: DataFrame | None = None,
                          benchmark: DataFrame | None = None) -> DataFrame:
    """Broken specification rules as (experiment_id, reason)."""
    joined = experiments.join(dataset_facts(datasets), "experiment_id", "left")
    report = violations(joined, ["experiment_id"], experiment_rules())
    gaps = limitation_gaps(datasets, experiments).select("experiment_id", F.lit("limitations_not_declared").alias("reason"))
    report = report.unionByName(gaps)
    if universe is not None:
        dates = experiments.select("experiment_id", "start_session", "end_session")
        outside = universe.join(dates, "experiment_id").where(
            (F.col("start_session") < F.col("listed_on")) | yes(F.col("end_session") >= F.col("delisted_on"))
        )
        report = report.unionByName(outside.select("experiment_id", F.lit("outside_listing").alias("reason")))
        if benchmark is not None:
            keys = ["experiment_id", "symbol"]
            strangers = benchmark.join(universe.select(*keys).distinct(), keys, "left_anti")
            report = report.unionByName(strangers.select("experiment_id", F.lit("benchmark_universe").alias("reason")))
    return report.distinct()


def binding_violations(
    contexts: DataFrame, experiments: DataFrame, datasets: DataFrame, observations: DataFrame,
    documents: DataFrame | None = None,
) -> DataFrame:
    """Contexts that do not agree with the specification of their run, as (context_id, reason).

    Each join hashes its small side, which is unique by its key in sound input, and lets the large one pass by: experiments under contexts,
    contexts under observations, declared datasets under observations. Rows that are many are never sorted.
    """
    c = F.col
    spec = experiments.select(
        "experiment_id", F.col("run_id").alias("__run"), F.col("mode").alias("__mode"),
        F.col("start_session").alias("__start"), F.col("end_session").alias("__end"),
    )
    declared = datasets.groupBy("experiment_id").agg(F.array_sort(F.collect_set("dataset_id")).alias("__datasets"))
    joined = contexts.join(spec.hint("shuffle_hash"), "experiment_id", "left").join(declared.hint("shuffle_hash"), "experiment_id", "left")
    rules = [
        ("different_run", differs(c("run_id"), c("__run"))),
        ("different_mode", differs(c("mode"), c("__mode"))),
        ("outside_range", ~yes(c("execution_session").between(c("__start"), c("__end")))),
        ("dataset_ids", differs(F.array_sort(F.array_distinct("dataset_ids")), c("__datasets"))),
    ]
    report = violations(joined, ["context_id"], rules)
    of_run = contexts.select("context_id", "experiment_id").hint("shuffle_hash")
    reference = datasets.select(
        "experiment_id", "dataset_id", F.struct("kind", "origin", "provider", "feed").alias("__ref"),
        F.struct("kind", "revision_policy").alias("__doc_ref"),
    ).hint("shuffle_hash")
    keys = ["experiment_id", "dataset_id"]
    own = F.struct(F.lit("market").alias("kind"), "origin", "provider", "feed")
    strange = observations.join(of_run, "context_id").join(reference, keys, "left").where(differs(own, c("__ref")))
    report = report.unionByName(strange.select("context_id", F.lit("observation_provenance").alias("reason")))
    if documents is not None:
        own = F.struct(F.lit("documents").alias("kind"), "revision_policy")
        strange = documents.join(of_run, "context_id").join(reference, keys, "left").where(differs(own, c("__doc_ref")))
        report = report.unionByName(strange.select("context_id", F.lit("document_provenance").alias("reason")))
    return report.distinct()


def instrument_mismatches(wanted: DataFrame, published: DataFrame, keys: list[str]) -> DataFrame:
    """Instruments whose whole row differs from the published one, or that are not published at all."""
    values = [n for n in wanted.columns if n not in keys]
    mine = wanted.select(*keys, F.struct(*values).alias("__mine"))
    theirs = published.select(*keys, F.struct(*values).alias("__theirs"))
    return mine.join(theirs, keys, "left").where(differs(F.col("__mine"), F.col("__theirs"))).select(*keys)


def snapshot_rules() -> list[Rule]:
    """An experiment row with the warm-up facts of the calendar and the plan of its snapshot."""
    c = F.col
    return [
        ("reference", differs(c("declared_reference"), c("snapshot_reference"))),
        ("coverage", ~yes(c("is_execution_session")) | (c("end_session") > c("coverage_end")) | ~yes(c("enough_warmup"))),
        ("warmup_before_listing", c("listed_on") > c("required_start")),
    ]


def set_equality(left: DataFrame, right: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Per key, whether both sides hold the same set of items; counted per item, so a large set is never gathered."""
    sides = left.select(*keys, item, F.lit(1).alias("__l"), F.lit(0).alias("__r")).unionByName(
        right.select(*keys, item, F.lit(0).alias("__l"), F.lit(1).alias("__r"))
    )
    items = sides.groupBy(*keys, item).agg(F.max("__l").alias("__l"), F.max("__r").alias("__r"))
    return items.groupBy(*keys).agg(
        F.sum("__l").alias("left_items"), F.sum("__r").alias("right_items"),
        F.bool_and(F.col("__l") == F.col("__r")).alias("equal"),
    )


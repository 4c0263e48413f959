"""Exposure of portfolios and the rules of target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import Rule, differs, duplicate_keys, no, violations

_MONEY = "decimal(34,8)"


def equity(cash: DataFrame, holdings: DataFrame) -> DataFrame:
    """Cash, receivable and marked holdings per portfolio."""
    marked = holdings.groupBy("portfolio").agg(
        F.sum(F.col("quantity").cast("decimal(18,0)") * F.col("raw_mark_usd").cast("decimal(18,8)")).alias("__value")
    )
    return cash.join(marked, "portfolio", "left").select(
        "portfolio",
        (F.col("cash_usd") + F.col("dividend_receivable_usd") + F.coalesce("__value", F.lit(0))).cast(_MONEY).alias("equity_usd"),
    )


def spendable(cash: DataFrame, pending: DataFrame) -> DataFrame:
    """Cash that is not reserved by pending orders; receivables do not count."""
    reserved = pending.groupBy("portfolio").agg(F.sum("reserved_cash_usd").alias("__reserved"))
    amount = F.col("cash_usd") - F.coalesce("__reserved", F.lit(0))
    return cash.join(reserved, "portfolio", "left").select(
        "portfolio", F.coalesce("__reserved", F.lit(0)).cast(_MONEY).alias("reserved_cash_usd"),
        amount.cast(_MONEY).alias("spendable_cash_usd"),
    )


def oversold(pending: DataFrame, holdings: DataFrame) -> DataFrame:
    """Symbols whose pending sells exceed what is held; nothing held counts as zero."""
    selling = pending.where(F.col("side") == "sell").groupBy("portfolio", "symbol").agg(
        F.sum("remaining_quantity").cast("bigint").alias("selling")
    )
    held = holdings.groupBy("portfolio", "symbol").agg(F.sum("quantity").cast("bigint").alias("held"))
    return selling.join(held, ["portfolio", "symbol"], "left").withColumn("held", F.coalesce("held", F.lit(0))).where(
        F.col("selling") > F.col("held")
    )


def pending_rules() -> list[Rule]:
    return [("sell_reserves_cash", (F.col("side") == "sell") & (F.col("reserved_cash_usd") != 0))]


def exposure_violations(cash: DataFrame, holdings: DataFrame, pending: DataFrame) -> DataFrame:
    """Broken portfolio rules as (portfolio, reason). ``cash`` carries ``as_of``, holdings ``marked_at``.

    Holdings and sells meet in one aggregate by symbol, these and the intentions in one by portfolio; each input is read once or twice
    and no task joins more than portfolios.
    """
    c = F.col
    flag = lambda name: F.max(name).alias(name)
    # Unknown portfolios and symbols hold nothing that could be sold.
    known = c("portfolio").isNotNull() & c("symbol").isNotNull()
    held = holdings.select("portfolio", "symbol", F.lit(1).cast("bigint").alias("copies"), F.when(known, c("quantity")).alias("held"), "marked_at")
    sold = pending.where(c("side") == "sell").select("portfolio", "symbol", c("remaining_quantity").alias("selling"))
    by_symbol = held.unionByName(sold, allowMissingColumns=True).groupBy("portfolio", "symbol").agg(
        F.sum("copies").alias("copies"), F.sum("held").alias("held"), F.sum("selling").alias("selling"), flag("marked_at"))
    symbols = by_symbol.select(
        "portfolio", "marked_at", (c("copies") > 1).alias("duplicate_holding"),
        (c("selling").cast("bigint") > F.coalesce(c("held").cast("bigint"), F.lit(0))).alias("sells_exceed_holding"))
    (reason, broken), = pending_rules()
    intentions = pending.groupBy("portfolio", "intention_id").agg(
        F.count(F.lit(1)).alias("copies"), F.sum("reserved_cash_usd").alias("reserved"), F.max(broken).alias(reason)
    ).select("portfolio", (c("copies") > 1).alias("duplicate_intention"), "reserved", reason)
    names = ["duplicate_holding", "sells_exceed_holding", "duplicate_intention", reason]
    facts = symbols.unionByName(intentions, allowMissingColumns=True).groupBy("portfolio").agg(
        flag("marked_at"), F.sum("reserved").alias("reserved"), *[flag(n) for n in names])
    # Portfolios without cash keep the rules that need none.
    joined = facts.join(cash.select("portfolio", "as_of", "cash_usd"), "portfolio", "full_outer")
    rules = [(n, c(n)) for n in names] + [
        ("mark_after_as_of", c("marked_at") > c("as_of")),
        ("reservations_exceed_cash", (c("cash_usd") - F.coalesce("reserved", F.lit(0))).cast(_MONEY) < 0)]
    return violations(joined, ["portfolio"], rules).distinct()


def outside_universe(exposure: DataFrame, universe: DataFrame, keys: list[str]) -> DataFrame:
    """Exposure to symbols that the universe does not contain."""
    return exposure.join(universe.select(*keys).distinct(), keys, "left_anti")


def target_totals(weights: DataFrame, keys: list[str]) -> DataFrame:
    """Total and cash weight per target set; weights are exact fractions."""
    total = F.sum("weight")
    return weights.groupBy(*keys).agg(total.alias("total_weight")).select(
        *keys, "total_weight", (F.lit(1) - F.col("total_weight")).alias("cash_weight"),
        F.when(F.col("total_weight") > 1, "total_above_one").alias("reason"),
    )


def benchmark_faults(weights: DataFrame, keys: list[str]) -> DataFrame:
    """Benchmark weights have to add up to more than zero and at most one."""
    return weights.groupBy(*keys).agg(F.sum("weight").alias("total_weight")).where(
        ~((F.col("total_weight") > 0) & (F.col("total_weight") <= 1))
    )


def target_violations(targets: DataFrame, weights: DataFrame, contexts: DataFrame, universe: DataFrame) -> DataFrame:
    """Whether target sets obey their own rules and those of the context they answer.

    ``targets`` may carry ``checked_at``; without a value the context's decision time is used.
    """
    c = F.col
    fields = ["run_id", "experiment_id", "strategy_name", "strategy_version", "decision_at", "execution_at", "expires_at"]
    bound = contexts.select(
        "context_id", *[c(n if n != "expires_at" else "target_expires_at").alias(f"__c_{n}") for n in fields],
    )
    checked = F.coalesce(c("checked_at"), c("__c_decision_at"))
    rules = [
        ("clock_order", no((c("feature_cutoff") <= c("decision_at")) & (c("decision_at") < c("execution_at"))
                           & (c("execution_at") < c("expires_at")))),
        ("different_run", differs(c("run_id"), c("__c_run_id")) | differs(c("experiment_id"), c("__c_experiment_id"))),
        ("different_strategy", differs(c("strategy_name"), c("__c_strategy_name"))
         | differs(c("strategy_version"), c("__c_strategy_version"))),
        ("different_clocks", differs(c("decision_at"), c("__c_decision_at")) | differs(c("execution_at"), c("__c_execution_at"))
         | differs(c("expires_at"), c("__c_expires_at"))),
        ("feature_cutoff", differs(c("feature_cutoff"), c("__c_decision_at"))),
        ("expired_or_future", ~((c("decision_at") <= checked) & (checked < c("expires_at")))),
    ]
    report = violations(targets.join(bound, "context_id", "left"), ["context_id"], rules)
    totals = target_totals(weights, ["context_id"]).where(c("reason").isNotNull()).select("context_id", "reason")
    strangers = outside_universe(weights, universe, ["context_id", "symbol"]).select(
        "context_id", F.lit("outside_universe").alias("reason")
    )
    copies = duplicate_keys(weights, ["context_id", "symbol"]).select("context_id", F.lit("duplicate_symbol").alias("reason"))
    return report.unionByName(totals).unionByName(strangers).unionByName(copies).distinct()

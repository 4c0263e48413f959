"""How often answers are right, supported, unknown or invalid, per category and overall, with resampled intervals."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Outcomes of an answer. Fixed values.
OUTCOMES = ("correct", "wrong", "unknown", "invalid")
REPLICATES = 40
#: Counts of a Poisson variable of mean one above this have less than one chance in 2^32.
_MOST = 12


def poisson_weights(row_id: Column, replicates: int, seed: int) -> Column:
    """How often each replicate draws a row: Poisson variables of mean one that depend on id, replicate and seed only."""
    edges = F.array(*[F.lit(e) for e in poisson_edges()])

    def weight(r: Column) -> Column:
        text = F.concat(row_id.cast("string"), F.lit("/"), r.cast("string"), F.lit(f"/{seed}"))
        place = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
        return F.aggregate(F.array(place), F.lit(0), lambda _, p: F.size(F.filter(edges, lambda e: p >= e)))

    return F.transform(F.sequence(F.lit(0), F.lit(replicates - 1)), weight)


def poisson_edges() -> list[int]:
    """The places between 0 and 2^32 from which on a count is 1, 2, ..."""
    return [math.floor(2**32 * sum(math.exp(-1) / math.factorial(k) for k in range(n + 1))) for n in range(_MOST)]


def category_rates(answers: DataFrame, categories: Sequence[str], row_id: str, outcome: str = "outcome", supported: str = "supported",
                   replicates: int = REPLICATES, seed: int = 1) -> DataFrame:
    """Counts, rates and an interval of the accuracy for every combination of categories, for each category and for all answers.

    Columns are the categories (null where put together; ``together`` counts those), the number of each outcome, ``answers``,
    ``accuracy`` among answers that are right or wrong, ``support_rate`` of those, ``unknown_rate`` and ``invalid_rate`` of all, and
    ``low`` and ``high``: the accuracies that one in forty replicates falls short of and exceeds. A rate of nothing is null. A
    replicate draws every row a Poisson number of times by its id, so weights are sums like the counts and everything is one
    aggregate; reruns agree whatever the partitions.
    """
    known = F.col(outcome).isin("correct", "wrong")
    right = (F.col(outcome) == "correct").cast("int")
    none = F.array_repeat(F.lit(0), replicates)
    rows = answers.where(F.col(outcome).isin(*OUTCOMES)).select(
        *categories, outcome, supported, F.when(known, poisson_weights(F.col(row_id), replicates, seed)).otherwise(none).alias("__w"))
    sets = [list(categories), *[[k] for k in categories if len(categories) > 1], []]
    counts = [F.count_if(F.col(outcome) == o).alias(o) for o in OUTCOMES]
    drawn = [s for r in range(replicates) for s in (F.sum(F.col("__w")[r]).alias(f"__d{r}"), F.sum(F.col("__w")[r] * right).alias(f"__r{r}"))]
    # Groups are told apart from null categories by what was put together.
    grouped = rows.groupingSets([[F.col(k) for k in s] for s in sets], *categories).agg(
        F.grouping_id().alias("__id"), F.count(F.lit(1)).alias("answers"), *counts,
        F.count_if(known & F.coalesce(F.col(supported), F.lit(False))).alias("supported"), *drawn)

    def rate(part: Column, whole: Column) -> Column:
        return part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))

    answered = F.col("correct") + F.col("wrong")
    accuracies = F.array_sort(F.filter(F.array(*[rate(F.col(f"__r{r}"), F.col(f"__d{r}")) for r in range(replicates)]), lambda x: x.isNotNull()))
    tail = F.floor(F.size(accuracies) / 40).cast("int")
    return grouped.select(
        *categories, F.bit_count("__id").alias("together"), "answers", *OUTCOMES, "supported", rate(F.col("correct"), answered).alias("accuracy"),
        rate(F.col("supported"), answered).alias("support_rate"), rate(F.col("unknown"), F.col("answers")).alias("unknown_rate"),
        rate(F.col("invalid"), F.col("answers")).alias("invalid_rate"), F.get(accuracies, tail).alias("low"),
        F.get(accuracies, F.size(accuracies) - 1 - tail).alias("high"))

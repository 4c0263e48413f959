"""Turning predicates into reason codes. A predicate that is null never counts as a violation by accident."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = tuple[str, Column]

# Patterns of constrained strings.
IDENTIFIER = r"^[A-Za-z0-9][A-Za-z0-9_.:-]{0,127}$"
DIGEST = r"^[a-f0-9]{64}$"
SYMBOL = r"^[A-Z][A-Z0-9.\-]{0,14}$"
REVISION = r"^[a-f0-9]{40}$"
UUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def yes(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def no(condition: Column) -> Column:
    """True when the condition is false or unknown: the form for required properties."""
    return ~yes(condition)


def differs(left: Column, right: Column) -> Column:
    return ~left.eqNullSafe(right)


def matches(column: Column, pattern: str) -> Column:
    return yes(column.rlike(pattern))


def first_reason(rules: Iterable[Rule]) -> Column:
    """The code of the first rule a row breaks, in the order given; null for a clean row."""
    return F.coalesce(*[F.when(yes(broken), F.lit(code)) for code, broken in rules])


def all_reasons(rules: Iterable[Rule]) -> Column:
    return F.array_compact(F.array(*[F.when(yes(broken), F.lit(code)) for code, broken in rules]))


def violations(df: DataFrame, keys: Sequence[str], rules: Iterable[Rule], name: str = "reason") -> DataFrame:
    """One row per key and broken rule, in one pass over the input."""
    return df.select(*keys, F.explode(all_reasons(list(rules))).alias(name))


def has_duplicates(array: Column) -> Column:
    return F.size(F.array_distinct(array)) < F.size(array)


def is_subset(part: Column, whole: Column) -> Column:
    return F.size(F.array_except(part, whole)) == 0


def duplicate_keys(df: DataFrame, keys: Sequence[str], name: str = "copies") -> DataFrame:
    """Keys that occur more than once. Counts are combined before the shuffle, hot keys included."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)).where(F.col(name) > 1)

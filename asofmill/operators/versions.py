"""Identity of dataset versions and the difference between two of them."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.identity import table_digest, with_row_digest


def plan_record(plan) -> str:
    """A plan (a dataclass) as one canonical text: sorted fields, dates and instants in ISO form."""
    return json.dumps(asdict(plan), sort_keys=True, separators=(",", ":"), default=lambda value: value.isoformat())


def dataset_identity(tables: dict[str, DataFrame], record: str = "") -> DataFrame:
    """One digest over a record of the dataset and its named tables: the digest of each table, hashed together in name order."""
    parts = None
    for name in sorted(tables):
        part = table_digest(tables[name]).select(F.lit(name).alias("name"), "rows", "digest")
        parts = part if parts is None else parts.unionByName(part)
    line = F.concat_ws(":", "name", F.col("rows").cast("string"), "digest")
    # One row per table of the dataset.
    return parts.agg(
        F.sha2(F.concat_ws("|", F.lit(record), F.array_sort(F.collect_list(line))), 256).alias("dataset_id"), F.sum("rows").alias("rows")
    )


def version_diff(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Added, removed and changed rows between two versions with unique keys; only digests are shuffled."""
    values = [c for c in new.columns if c not in keys]
    before = with_row_digest(old, values, "old_digest").select(*keys, "old_digest")
    after = with_row_digest(new, values, "new_digest").select(*keys, "new_digest")
    joined = before.join(after, list(keys), "full_outer")
    change = (
        F.when(F.col("old_digest").isNull(), "added").when(F.col("new_digest").isNull(), "removed")
        .when(F.col("old_digest") != F.col("new_digest"), "changed")
    )
    return joined.withColumn("change", change).where(F.col("change").isNotNull()).select(*keys, "change")


def rows_differ(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows held by one side only, with multiplicity; empty means the two tables are the same bag.

    One grouped count instead of two set differences.
    """
    sides = left.withColumn("__n", F.lit(1)).unionByName(right.withColumn("__n", F.lit(-1)))
    return (
        sides.groupBy(*left.columns).agg(F.sum("__n").alias("surplus")).where(F.col("surplus") != 0)
    )


def sequence_mismatch(rows: DataFrame, calendar: DataFrame, key: str) -> DataFrame:
    """Keys that only one of two key columns contains."""
    return rows_differ(rows.select(key), calendar.select(key))

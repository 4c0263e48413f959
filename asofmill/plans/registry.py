"""Registered queries and the SQL that states their result independently."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clocks import utc_text
from ..session import pin

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def portable(df: DataFrame) -> DataFrame:
    """Results in types every engine prints alike: dates and instants as text, decimals as doubles, arrays as text."""
    columns = []
    for field in df.schema:
        kind = field.dataType.typeName()
        column = F.col(field.name)
        if kind == "date":
            column = column.cast("string")
        elif kind in ("timestamp", "timestamp_ntz"):
            column = utc_text(column)
        elif kind == "decimal":
            column = column.cast("double")
        elif kind == "array":
            column = F.array_join(column.cast("array<string>"), ",")
        columns.append(column.alias(field.name))
    return df.select(*columns)


def query(sql: str | None = None, name: str | None = None):
    """Register ``fn(spark, sf_dir)`` under its name, with the oracle SQL if SQL can state the result."""

    def register(fn):
        key = name or fn.__name__
        QUERIES[key] = lambda spark, sf: portable(fn(pin(spark), sf))
        if sql:
            ORACLES[key] = sql
        return fn

    return register

"""Helpers all operators of this subpackage share: row identity, filtering by decisions, word counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space as the contracts define it: blank, tab to carriage return. Fixed value.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def text_or_empty(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def row_key(text: str | Column) -> Column:
    """Tells rows that share an id apart. Only compared between rows of one id, so 64 bits suffice."""
    return F.xxhash64(text_or_empty(text))


def word_count(text: str | Column) -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def fresh(taken: list[str], wanted: str) -> str:
    """A column name the table does not have yet (Spark compares names without case)."""
    lower = {name.lower() for name in taken}
    while wanted.lower() in lower:
        wanted += "_"
    return wanted


def keep_rows(docs: DataFrame, wanted: DataFrame, repeated: bool, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose (id, row key) is in ``wanted`` (columns id, x), all columns unchanged.

    A semi join never multiplies rows. With ``repeated``, one of several rows with the same id and text stays.
    """
    x = fresh(docs.columns, "_x")
    left = docs.withColumn(x, row_key(text_col))
    right = wanted.select(F.col("id").alias("_keep_id"), F.col("x").alias("_keep_x")).alias("_wanted")
    found = left.join(right, left[id_col].eqNullSafe(right["_keep_id"]) & (left[x] == right["_keep_x"]), "left_semi")
    return (found.dropDuplicates([id_col, x]) if repeated else found).drop(x)

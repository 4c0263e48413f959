"""Content identity of values, rows, groups and whole tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .clocks import utc_text
from .exact import number_text


def sha256(value: Column) -> Column:
    return F.sha2(value, 256)


def canonical_json(fields: Mapping[str, Column]) -> Column:
    """One JSON object with sorted keys, no spaces and explicit nulls."""
    ordered = [column.alias(name) for name, column in sorted(fields.items())]
    return F.to_json(F.struct(*ordered), {"ignoreNullFields": "false"})


def canonical_fields(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, Column]:
    """The canonical value of each column: decimals and instants as text, the rest as they are."""
    chosen = columns or df.columns
    fields = {}
    for field in df.schema:
        if field.name not in chosen:
            continue
        kind = field.dataType.typeName()
        column = F.col(field.name)
        if kind == "decimal":
            column = number_text(column)
        elif kind in ("timestamp", "timestamp_ntz"):
            column = utc_text(column)
        elif kind == "date":
            column = column.cast("string")
        fields[field.name] = column
    return fields


def record_id(fields: Mapping[str, Column]) -> Column:
    return sha256(canonical_json(fields))


def with_row_digest(df: DataFrame, columns: Sequence[str] | None = None, name: str = "row_digest") -> DataFrame:
    return df.withColumn(name, record_id(canonical_fields(df, columns)))


# A digest has 64 hexadecimal characters; 16 words of 4 keep each sum inside bigint beyond 10^14 rows.
_WORDS = 16


def table_digest(
    df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = (), name: str = "digest"
) -> DataFrame:
    """Digest of a bag of rows, for the table or per group.

    Row digests are split into words, the words summed, and the sums hashed together with the row count. Sums are
    combined before the shuffle, so no group is ever gathered in one place and neither file layout nor row order
    matters. It tells honest versions apart; it is no defence against someone who crafts rows to collide.
    """
    rows = with_row_digest(df, columns, "__digest").select(*by, "__digest")
    words = [
        F.sum(F.conv(F.substring("__digest", 1 + 4 * i, 4), 16, 10).cast("bigint")).alias(f"__w{i}")
        for i in range(_WORDS)
    ]
    summed = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), *words)
    text = F.concat_ws(
        "|", F.col("rows").cast("string"), *[F.coalesce(F.col(f"__w{i}"), F.lit(0)).cast("string") for i in range(_WORDS)]
    )
    return summed.select(*by, "rows", sha256(text).alias(name))


def digest_halves(content: Column) -> tuple[Column, Column]:
    """Half of a sha-256 as two numbers. Unlike text, numbers keep an aggregate of them hash-based."""
    digest = sha256(content)
    return tuple(F.conv(F.substring(digest, at, 16), 16, 10).cast("decimal(20,0)") for at in (1, 17))


def content_versions(df: DataFrame, keys: Sequence[str], content: Column, copies: str = "copies") -> DataFrame:
    """Keys that carry more than one content, with their number of rows."""
    high, low = digest_halves(content)
    grouped = df.select(*keys, high.alias("__a"), low.alias("__b")).groupBy(*keys).agg(
        F.count(F.lit(1)).alias(copies), F.min("__a").alias("__a0"), F.max("__a").alias("__a1"),
        F.min("__b").alias("__b0"), F.max("__b").alias("__b1"),
    )
    return grouped.where((F.col("__a0") != F.col("__a1")) | (F.col("__b0") != F.col("__b1"))).select(*keys, copies)


def ordered_digest(text: str, order: str) -> Column:
    """Aggregate: sha-256 over the concatenated ``text`` in ``order``.

    Only for groups with a bound of their own, such as the minutes of one session.
    """
    return F.sha2(F.expr(f"listagg({text}, '') WITHIN GROUP (ORDER BY {order})"), 256)

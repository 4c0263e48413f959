"""Scans of stored tables."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rules import DIGEST
from ..schemas import SchemaMismatch, require
from ..session import pin


def driver_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return pin(spark).read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def parquet_table(spark: SparkSession, path: str, schema: T.StructType, rows: int | None = None) -> DataFrame:
    """Scan with exactly the declared columns; a table with other columns is refused before any row is read.

    With ``rows``, the count of a manifest, a table of another size is refused too (a count reads file footers only).
    """
    found = require(pin(spark).read.parquet(path), schema)
    if rows is not None and (stored := found.count()) != rows:
        raise SchemaMismatch(f"expected {rows} rows, found {stored}")
    return found


def snapshot_table(spark: SparkSession, root: str, table: str, dataset_id: str) -> DataFrame:
    """One dataset version by its content id; the id is a partition, so other versions are not read."""
    if not re.fullmatch(DIGEST, dataset_id):
        raise ValueError("dataset_id must be a lowercase sha-256")
    return pin(spark).read.parquet(f"{root.rstrip('/')}/{table}").where(F.col("dataset_id") == dataset_id)


def csv_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return pin(spark).read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def json_table(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = False) -> DataFrame:
    return pin(spark).read.schema(schema).option("multiLine", multi_line).option("mode", "FAILFAST").json(path)


def capture_files(spark: SparkSession, path: str) -> DataFrame:
    """One text per capture file, with the digest of its bytes and the id its file name claims."""
    raw = pin(spark).read.option("wholetext", True).text(path)
    name = F.regexp_extract(F.input_file_name(), r"([a-f0-9]{64})\.json$", 1)
    digest = F.sha2("value", 256)
    return raw.select(
        name.alias("capture_id"), F.col("value").alias("body"), digest.alias("digest"),
        (digest != name).alias("corrupt"),
    )


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """Path, sha-256 and size of artifact files, for manifests and audits of small result files."""
    files = pin(spark).read.format("binaryFile").load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size_bytes"))


def spread(df: DataFrame) -> DataFrame:
    """Hand rows out to all task slots where a scan gives them to few, before costly work per row.

    Splits go by bytes, rows by row groups: a file of a few large groups has many splits and most of them are empty. So rows are
    counted per split (from the footers only) and an even table passes through untouched, without a shuffle.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    counted = df.groupBy(F.spark_partition_id().alias("split")).agg(F.count(F.lit(1)).alias("n"))
    found = counted.agg(F.max("n").alias("most"), F.sum("n").alias("total"), F.max("split").alias("last")).first()
    if found["total"] is None or found["most"] * slots <= 2 * found["total"]:
        return df
    # Some more parts than slots, so that the last ones do not run alone.
    return df.repartition(max(3 * slots, found["last"] + 1))


_ARROW = {"string": pa.string(), "date": pa.date32(), "int": pa.int32(), "bigint": pa.int64()}


def literal_rows(spark: SparkSession, rows: Iterable[tuple], columns: str) -> DataFrame:
    """A few constant rows. They travel as Arrow, so they are part of the plan and need no Python tasks."""
    pairs = [column.split() for column in columns.split(",")]
    values = list(zip(*rows))
    table = pa.table({name: pa.array(column, type=_ARROW[kind]) for (name, kind), column in zip(pairs, values)})
    return pin(spark).createDataFrame(table)

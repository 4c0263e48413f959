"""Writing dataset versions, captures and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import table_digest
from ..functions.rules import violations
from ..operators import records as R
from ..operators.quality import Plan, is_usable, quality_findings
from ..operators.versions import dataset_identity, plan_record
from ..session import staged


class QualityRejected(ValueError):
    """The dataset has at least one error finding; nothing was written."""


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    writer = df.write.mode(mode).option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def is_published(spark: SparkSession, root: str, dataset_id: str) -> bool:
    """A version counts as published once its manifest row exists; that row is written last."""
    try:
        manifest = spark.read.schema("dataset_id string, rows bigint").parquet(f"{root}/manifest")
        return not manifest.where(F.col("dataset_id") == dataset_id).isEmpty()
    except AnalysisException:
        return False


def record_faults(bars: DataFrame, actions: DataFrame, universe: DataFrame) -> DataFrame:
    """(table, reason, n): broken rules of single records; a table that is published has none."""
    parts = []
    for name, df, keys, rules in (
        ("bars", bars, ["symbol", "session"], R.bar_rules()), ("actions", actions, ["action_id"], R.action_rules()),
        ("universe", universe, ["symbol"], R.instrument_rules()),
    ):
        parts.append(violations(df, keys, rules).groupBy("reason").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "reason", "n"))
    return reduce(DataFrame.unionAll, parts)


def publish_snapshot(
    root: str, plan: Plan, universe: DataFrame, bars: DataFrame, actions: DataFrame, sessions: DataFrame
) -> str:
    """Check records and quality, derive the id from plan, content and findings, write one new version per table; return the id.

    The same plan and content give the same id and are not written twice; a change of either gives another id and leaves the
    old version alone. The tables are staged first, so what is checked, hashed and stored are the same rows. The id is one
    value and the verdicts one row per broken rule, the only data that reach the driver.
    """
    faults = plan.faults()
    if faults:
        raise QualityRejected(", ".join(faults))
    spark = bars.sparkSession
    given = {"bars": bars, "actions": actions, "sessions": sessions, "universe": universe}
    tables = {name: staged(df, f"publish-{name}") for name, df in given.items()}
    broken = record_faults(tables["bars"], tables["actions"], tables["universe"]).orderBy("table", "reason").collect()
    if broken:
        raise QualityRejected(", ".join(f"unsupported_records {r['table']}.{r['reason']} x{r['n']}" for r in broken))
    findings = staged(quality_findings(plan, tables["universe"], tables["bars"], tables["actions"], tables["sessions"]), "publish-findings")
    if not is_usable(findings).first()["usable"]:
        codes = findings.where("severity = 'error'").groupBy("code").count().orderBy("code")
        raise QualityRejected(", ".join(f"{r['code']} x{r['count']}" for r in codes.collect()))
    identity = dataset_identity({**tables, "findings": findings}, plan_record(plan)).first()
    dataset_id = identity["dataset_id"]
    if is_published(spark, root, dataset_id):
        return dataset_id
    for name, df in tables.items():
        # Written straight into its partition: a rerun after a lost driver replaces a half-written version.
        write_table(df, f"{root}/{name}/dataset_id={dataset_id}", mode="overwrite")
    counts = {name: df.count() for name, df in tables.items()}
    manifest = spark.createDataFrame(
        [(dataset_id, sum(counts.values()), plan_record(plan), counts)], "dataset_id string, rows bigint, plan string, tables map<string,bigint>")
    write_table(manifest, f"{root}/manifest", mode="append")
    return dataset_id


class CaptureConflict(ValueError):
    """A capture is already stored with other pages; nothing was written."""


def append_captures(pages: DataFrame, stored: DataFrame, path: str) -> None:
    """Append pages of captures that are not stored yet; a stored capture with other content is refused.

    Both sides are digested per capture with partial sums, so a capture of any size is one row where they meet.
    """
    names = pages.columns
    held = table_digest(_hashable(stored.select(*names)), by=["capture_id"]).select("capture_id", F.col("digest").alias("held"))
    given = table_digest(_hashable(pages), by=["capture_id"]).join(held, "capture_id", "left")
    conflicts = [r["capture_id"] for r in given.where(F.col("held") != F.col("digest")).select("capture_id").orderBy("capture_id").limit(20).collect()]
    if conflicts:
        raise CaptureConflict(", ".join(conflicts))
    fresh = pages.join(stored.select("capture_id").distinct(), "capture_id", "left_anti")
    write_table(fresh, path, mode="append")


def _hashable(pages: DataFrame) -> DataFrame:
    """Maps as sorted entries, whose text does not depend on the order of their keys."""
    maps = [f.name for f in pages.schema if f.dataType.typeName() == "map"]
    return pages.withColumns({name: F.array_sort(F.map_entries(name)) for name in maps}) if maps else pages


def append_receipt(receipts: DataFrame, path: str) -> None:
    """Receipts are appended; readers take the newest per request."""
    write_table(receipts, path, mode="append")


def inspection_report(dataset_id: str, coverage: DataFrame, findings: DataFrame) -> DataFrame:
    """One JSON document per symbol of a dataset: its coverage and its finding counts."""
    counts = findings.where(F.col("symbol").isNotNull()).groupBy("symbol", "code").agg(F.count(F.lit(1)).alias("n"))
    # At most one entry per finding code.
    by_symbol = counts.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("code", "n"))).alias("findings"))
    empty = F.array().cast("array<struct<code:string,n:bigint>>")
    joined = coverage.join(by_symbol, "symbol", "left").withColumn("findings", F.coalesce("findings", empty))
    body = F.to_json(F.struct(
        "bars", F.lit(dataset_id).alias("dataset_id"), "findings", F.col("first_session").cast("string").alias("first_session"),
        F.col("last_session").cast("string").alias("last_session"), "symbol", "zero_volume_bars",
    ))
    return joined.select("symbol", body.alias("report"))


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("errorifexists").text(path)

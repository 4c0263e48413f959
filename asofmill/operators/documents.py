"""Source documents, quotations from them and the assessments that cite them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.identity import sha256
from ..functions.rules import Rule, differs, has_duplicates, is_subset, no, violations
from ..functions.text import characters


def document_rules() -> list[Rule]:
    c = F.col
    return [
        ("clock_order", no((c("published_at") <= c("available_at")) & (c("available_at") <= c("first_ingested_at")))),
        ("content_hash", differs(sha256(c("original_text")), c("content_sha256"))),
    ]


def verify_quotes(evidence: DataFrame, documents: DataFrame, keys: Sequence[str] = ("document_id",)) -> DataFrame:
    """Each quotation with a verdict: ``ok`` or the first reason why it does not hold.

    ``evidence`` has document_id, content_sha256, start, end (characters) and text. A much-cited document makes its
    key hot on the evidence side only; adaptive execution splits such a partition. ``keys`` says what a document is known by.
    """
    sources = documents.select(*keys, F.col("content_sha256").alias("__hash"), F.col("original_text").alias("__text"))
    joined = evidence.join(sources, list(keys), "left")
    verdict = (
        F.when((F.col("end") - F.col("start")) != F.length("text"), "span_length")
        .when(F.col("__hash").isNull(), "missing_document")
        .when(differs(F.col("__hash"), F.col("content_sha256")), "content_hash")
        .when(differs(characters(F.col("__text"), F.col("start"), F.col("end")), F.col("text")), "span_text")
        .otherwise("ok")
    )
    return joined.withColumn("verdict", verdict).drop("__hash", "__text")


def missing_documents(references: DataFrame, documents: DataFrame) -> DataFrame:
    return references.join(documents.select("document_id").distinct(), "document_id", "left_anti")


def late_documents(references: DataFrame, documents: DataFrame) -> DataFrame:
    """Cited documents that became available after the assessment's source cutoff."""
    clocks = documents.select("document_id", "available_at")
    return references.join(clocks, "document_id").where(F.col("available_at") > F.col("source_cutoff"))


def assessment_rules() -> list[Rule]:
    """Rules of one assessment; document references and cited ids are arrays on the row."""
    c = F.col
    referenced = F.concat("source_document_ids", "comparison_document_ids")
    known = (c("policy_direction") != "unknown") | (c("concern_change") != "unknown")
    both = F.arrays_overlap("cited_ids", "source_document_ids") & F.arrays_overlap("cited_ids", "comparison_document_ids")
    return [
        ("duplicate_reference", has_duplicates(referenced)),
        ("clock_order", ~((c("source_cutoff") <= c("generated_at")) & (c("source_cutoff") < c("expires_at")))),
        ("generated_after_expiry", (c("use") == "prospective") & (c("generated_at") >= c("expires_at"))),
        ("model_cutoff", c("training_cutoff") > c("generated_at")),
        ("undeclared_citation", ~is_subset(F.col("cited_ids"), referenced)),
        ("one_sided_evidence", known & ~both),
    ]


def assessment_violations(assessments: DataFrame) -> DataFrame:
    return violations(assessments, ["assessment_id"], assessment_rules())


def duplicate_contents(documents: DataFrame, text: str = "original_text") -> DataFrame:
    """Contents held by more than one document: count, first and last id."""
    return (
        documents.select("document_id", sha256(F.col(text)).alias("content_sha256"))
        .groupBy("content_sha256")
        .agg(F.count(F.lit(1)).alias("copies"), F.min("document_id").alias("first_id"), F.max("document_id").alias("last_id"))
        .where(F.col("copies") > 1)
    )

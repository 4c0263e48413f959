"""Licence scan by canonical digests.

A text is brought to a canonical form: lower case, British spellings replaced by their equivalents, lines that start with a
copyright mark dropped, everything but letters and digits turned into single blanks. Entire texts (a whole document, and each of
its lines) whose canonical form has the digest of a known licence are reported.

Defined results: a null or empty text and a line without letters or digits match nothing; each repeated row and each repeated line
is reported; a null id is reported as null; of known texts with the same canonical form the first identifier by name is used;
extra columns are ignored; an empty table gives an empty result.

Plan (DataFrame functions only): no shuffle. Units whose length no known text has are dropped before they are hashed; the rest
meets the digest table in a hash join. The table has one row per known text, a fixed list, so its broadcast is bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_texts import KNOWN
from .rows import text_or_empty

#: Spellings that mean the same. Fixed values.
EQUIVALENT = [("licence", "license"), ("sub-license", "sublicense"), ("non-infringement", "noninfringement"), ("organisation", "organization"),
              ("authorisation", "authorization"), ("https://", "http://"), ("and/or", "and or")]
#: A line that only says whose the text is.
COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n]*(?:copyright|\(c\)|©|all rights reserved)(?=[^\p{L}\p{N}]|$)[^\n]*$"
_GAP = r"[^\p{L}\p{N}\n]+"


def canonical_lines(text: str | Column) -> Column:
    """The canonical form, line by line."""
    column = F.regexp_replace(F.lower(text_or_empty(text)), COPYRIGHT_LINE, "")
    for old, new in EQUIVALENT:
        column = F.replace(column, F.lit(old), F.lit(new))
    return F.transform(F.split(F.regexp_replace(column, _GAP, " "), "\n"), lambda line: F.trim(line))


def whole(lines: Column) -> Column:
    return F.array_join(F.filter(lines, lambda line: line != ""), " ")


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """(digest, chars, license) of known texts."""
    table = spark.createDataFrame(list(known or KNOWN), "license string, text string")
    canonical = whole(canonical_lines("text"))
    return table.select("license", canonical.alias("body")).where("body <> ''").groupBy(
        F.sha2("body", 256).alias("digest"), F.length("body").alias("chars")).agg(F.min("license").alias("license"))


def license_scan(docs: DataFrame, known: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per entire text that is a known licence: doc_id, unit (text or line), line (1 for the first, 0 for the whole text),
    license, digest."""
    digests = known_digests(docs.sparkSession, known)
    lengths = [r.chars for r in digests.select("chars").distinct().collect()]
    body = docs.select(F.col(id_col).cast("long").alias("doc_id"), canonical_lines(text_col).alias("lines"))
    units = F.concat(
        F.array(F.struct(F.lit(0).alias("line"), whole(F.col("lines")).alias("body"))),
        F.filter(F.transform("lines", lambda line, n: F.struct((n + 1).alias("line"), line.alias("body"))), lambda u: F.length(u["body"]).isin(lengths)))
    rows = body.select("doc_id", F.explode(units).alias("u")).where(F.length("u.body").isin(lengths)).select(
        "doc_id", F.col("u.line").alias("line"), F.sha2("u.body", 256).alias("digest"))
    return rows.join(F.broadcast(digests.select("digest", "license")), "digest").select(
        "doc_id", F.when(F.col("line") == 0, "text").otherwise("line").alias("unit"), "line", "license", "digest")

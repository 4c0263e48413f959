"""A corpus pipeline of five operators. Every stage works on all its predecessor kept and is written before the next reads it.

Filtering stages return the columns of documents. The mixture repeats documents; the last stage encodes what it holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from asofmill.llm.bpe import encode_digests
from asofmill.llm.exact_dedup import drop_exact_copies
from asofmill.llm.mixing import take_mix
from asofmill.llm.near_copies import drop_similar
from asofmill.llm.queries import tokenizer_path
from asofmill.llm.toxicity import drop_toxic
from asofmill.session import pin, staged


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier rejects go."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one stays."""
    return drop_exact_copies(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similarity 0.8 or more of their five-word shingles one stays."""
    return drop_similar(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come near their target weights; a document taken twice is two rows."""
    return take_mix(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of every row and the digests of tokens and decoded text."""
    return encode_digests(docs, tokenizer_path())


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("simhash_dedup", simhash_dedup), ("mix", mix), ("bpe", bpe)]

#: The classifier and the fingerprints cannot be stated in SQL; tests/llm compares with plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder and read again."""
    pin(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

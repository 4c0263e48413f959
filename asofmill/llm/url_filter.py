"""URL filtering: a blocked Bloom filter of listed canonical URLs, then an exact hash join that removes false positives.

A rule lists a host and a path, written like ``example.net/en/``, with a verdict. It fits a URL whose host is the rule's or a
subdomain of it and whose path starts with the rule's. The longest rule that fits wins (host and path together); URLs without
a rule get the verdict of the list's default.

Canonical form: the host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; the path is
what follows up to ``?``, ``#`` or the end. A URL is looked up under every suffix of its host and every prefix of its path that a
listed rule could equal: suffixes of at most as many labels as a rule has, prefixes of the lengths rules have.

Defined results: a null URL and one without ``://`` have empty host and path, which no rule fits; of rules listed twice, block
wins; repeated rows get equal results; a rule or verdict that is null is left out; extra columns are ignored; an empty table or
list gives an empty result or the default.

Plan: rules become bits of the filter by an aggregate (``bit_or`` per 64-bit word), so the list is never collected; the filter
itself is of fixed size (``FILTER_BYTES`` at most) and broadcast. Distinct (host, path) pairs are looked up once, so a hot URL
costs one row per task. Only keys the filter lets through become rows and meet the rules in a join on the key; rules of a hot key
are one row each. The verdict of each distinct pair is written and joined back to the pages; adaptive execution splits a hot pair.
URLs without a host pass by all of this.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged

BLOCK_WORDS = 8  # 512 bits, a cache line
PROBES = 8
BITS_PER_RULE = 16
FILTER_BYTES = 64 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_suffixes(host: Column, labels: int) -> Column:
    """The host's suffixes of one to ``labels`` labels."""
    return F.array_distinct(F.array(*[F.substring_index(host, ".", -n) for n in range(1, max(1, labels) + 1)]))


def path_prefixes(path: Column, lengths: list[int]) -> Column:
    """The path's prefixes of the given lengths."""
    fitting = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(path))
    return F.transform(fitting, lambda n: F.substring(path, F.lit(1), n))


def rule_keys(rules: DataFrame) -> DataFrame:
    """(key, host, path, verdict): one row per listed host and path."""
    host = F.translate(F.substring_index("rule", "/", 1), _UPPER, _LOWER)
    path = F.substring(F.col("rule"), F.length(host) + 1, F.length("rule"))
    block = F.max((F.col("verdict") == "block").cast("int"))
    return rules.where(F.col("rule").isNotNull() & F.col("verdict").isin("block", "allow")).select(
        host.alias("rule_host"), path.alias("rule_path"), "verdict").groupBy("rule_host", "rule_path").agg(block.alias("blocks")).select(
        F.concat("rule_host", "rule_path").alias("rule"), "rule_host", "rule_path",
        F.when(F.col("blocks") == 1, "block").otherwise("allow").alias("rule_verdict"))


def _probe(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Word positions (n, PROBES) and bits: one block per hash, PROBES bits inside it by double hashing."""
    mixed = (hashes ^ (hashes >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    mixed ^= mixed >> np.uint64(29)
    block = (mixed >> np.uint64(20)) % np.uint64(blocks)
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    bit = (hashes[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]) % np.uint64(64 * BLOCK_WORDS)
    return (block[:, None] * np.uint64(BLOCK_WORDS) + bit // np.uint64(64)).astype(np.int64), np.uint64(1) << (bit % np.uint64(64))


class BlockedBloom:
    """Words of the filter; a key sets all its bits inside one block."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def maybe(self, hashes: np.ndarray) -> np.ndarray:
        at, bits = _probe(hashes.astype(np.int64).view(np.uint64), len(self.words) // BLOCK_WORDS)
        return ((self.words[at] & bits) == bits).all(axis=1)


def build_filter(keys: DataFrame, count: int, key_col: str = "rule") -> BlockedBloom:
    """The filter of all keys; words are combined by Spark, the driver gets at most ``FILTER_BYTES``."""
    blocks = max(1, min(FILTER_BYTES // (8 * BLOCK_WORDS), -(-count * BITS_PER_RULE // (64 * BLOCK_WORDS))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at, bits = _probe(batch["h"].to_numpy(dtype=np.int64).view(np.uint64), blocks)
            yield pd.DataFrame({"word": at.ravel(), "bits": bits.ravel().view(np.int64)})

    made = keys.select(F.xxhash64(key_col).alias("h")).mapInPandas(run, "word long, bits long")
    words = np.zeros(blocks * BLOCK_WORDS, dtype=np.uint64)
    table = made.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words[table["word"].to_numpy()] = table["bits"].to_numpy().astype(np.int64).view(np.uint64)
    return BlockedBloom(words)


def filtered(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule (null if none fits), verdict."""
    keyed = pages.select(F.col(id_col).cast("long").alias("page_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    listed = rule_keys(rules)
    facts = listed.agg(F.count(F.lit(1)), F.max(F.size(F.split("rule_host", r"\."))), F.collect_set(F.length("rule_path"))).first()
    if not facts[0]:
        return keyed.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    bloom = pages.sparkSession.sparkContext.broadcast(build_filter(listed, facts[0]))

    @F.pandas_udf("array<int>")
    def passing(hashes: pd.Series) -> pd.Series:
        size = hashes.map(len).to_numpy()
        if not size.sum():
            return pd.Series([[]] * len(size), dtype=object)
        hit = bloom.value.maybe(np.concatenate([np.asarray(h, dtype=np.int64) for h in hashes]))
        at = np.split(hit, np.cumsum(size)[:-1])
        return pd.Series([np.nonzero(a)[0].astype(np.int32) for a in at], dtype=object)

    suffixes, prefixes = host_suffixes(F.col("host"), facts[1]), path_prefixes(F.col("path"), sorted(facts[2]))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    distinct = keyed.where("host <> ''").groupBy("host", "path").agg(F.count(F.lit(1)).alias("_n")).select("host", "path", keys.alias("keys"))
    tried = distinct.withColumn("hits", passing(F.transform("keys", lambda k: F.xxhash64(k))))
    possible = tried.select("host", "path", F.explode(F.transform("hits", lambda n: F.element_at("keys", n + 1))).alias("key"))
    # The join compares the strings themselves. Length and key make a number whose order is the order of the rules.
    fits = possible.join(listed, possible["key"] == listed["rule"]).where(
        ((F.col("host") == F.col("rule_host")) | F.col("host").endswith(F.concat(F.lit("."), "rule_host"))) & F.col("path").startswith(F.col("rule_path")))
    # Written, so that the join below is split where a URL is hot: adaptive execution splits no side that ends in an aggregate.
    best = staged(fits.groupBy("host", "path").agg(F.max(F.struct(F.length("rule"), "rule", "rule_verdict")).alias("best")).select(
        F.col("host").alias("_h"), F.col("path").alias("_p"), "best.rule", "best.rule_verdict"), "url-verdicts")
    found = keyed.where("host <> ''").join(best, (F.col("host") == F.col("_h")) & (F.col("path") == F.col("_p")), "left")
    return found.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", F.lit(default)).alias("verdict")).unionByName(
        keyed.where("host = ''").select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict")))

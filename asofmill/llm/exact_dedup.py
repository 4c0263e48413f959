"""Exact de-duplication by 128-bit content hash with a comparison of bytes inside each group.

Texts are equal when they are identical after all white space (blank, tab to carriage return) is deleted. Of equal texts
the row with the most code points stays, then the smallest id.

Defined results: a null text counts as empty and all empty texts form one group; a null id sorts behind every other id; of
rows that repeat id and text exactly one stays; extra columns are ignored; an empty table gives an empty result.

Plan: one pass writes ids and digests; rows with the same id and text are counted together before they move. Groups are
partial aggregates, so a hot group costs one row per task. Only groups of two or more fetch their texts again, and the
representative of a group is repeated once per ``MEMBERS_PER_COPY`` members, so no join key is hot.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .rows import SPACE, keep_rows, row_key, text_or_empty

#: Members of a group that are compared with one copy of its representative.
MEMBERS_PER_COPY = 1000

_SHIFT = "100000000000000000000"  # 10^20 holds twice the range of a bigint
_TOP = "9223372036854775808"


def normalised(text: str | Column) -> Column:
    return F.regexp_replace(text_or_empty(text), SPACE + "+", "")


def content_hash(normal: Column) -> Column:
    return F.md5(normal)


def _rank(chars: str, key: str) -> Column:
    """Larger is better: more code points, then the smaller id, null ids last. A number keeps the aggregate hash based."""
    place = F.coalesce(F.expr(f"cast({_TOP} as decimal(20,0)) - {key}"), F.expr("cast(0 as decimal(20,0))"))
    return (F.col(chars).cast("decimal(18,0)") * F.expr(f"cast({_SHIFT} as decimal(21,0))") + place).cast("decimal(38,0)")


def _ranked_id(rank: str) -> Column:
    place = F.expr(f"{rank} % cast({_SHIFT} as decimal(21,0))")
    return F.when(place > 0, (F.expr(f"cast({_TOP} as decimal(20,0))") - place).cast("long"))


def _grouped(units: DataFrame, *keys: str) -> DataFrame:
    """Units with the size of their group and the rank of the row that stays."""
    # Written first: adaptive execution splits a hot key of a join only where both sides come straight from a shuffle.
    groups = staged(units.groupBy(*keys).agg(F.sum("copies").alias("group_size"), F.max("rank").alias("best")), "exact-sizes")
    return units.join(groups, list(keys))


def _texts(docs: DataFrame, units: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Units with their normalised text, one row each."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), row_key(text_col).alias("x"), normalised(text_col).alias("normal"))
    own = units.withColumnsRenamed({"id": "_id", "x": "_x"})
    joined = source.join(own, F.col("id").eqNullSafe(F.col("_id")) & (F.col("x") == F.col("_x"))).drop("_id", "_x")
    if units.where(F.col("copies") > 1).isEmpty():
        return joined
    # Only rows that repeat id and text can multiply here; one of them is enough.
    return joined.where(F.col("copies") == 1).unionByName(joined.where(F.col("copies") > 1).dropDuplicates(["id", "x"]))


def _unequal(members: DataFrame) -> DataFrame:
    """Hashes whose members are not all identical to their representative."""
    copies = F.ceil(F.col("group_size") / F.lit(MEMBERS_PER_COPY)).cast("int")
    slot = F.pmod(F.xxhash64("id", "x"), copies).cast("int")
    first = members.where(F.col("rank") == F.col("best")).select(
        F.col("h").alias("rh"), F.col("normal").alias("first"), F.explode(F.sequence(F.lit(0), copies - 1)).alias("rslot"))
    rest = members.select("h", "normal", slot.alias("slot"))
    joined = rest.join(first, (rest["h"] == first["rh"]) & (rest["slot"] == first["rslot"]))
    return joined.where(F.col("normal") != F.col("first")).select("h").distinct()


def exact_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                hasher: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per distinct (id, text) with copies, rank, best, group_size and sha; ``hasher`` gives the content hash."""
    normal = normalised(text_col)
    digests = staged(docs.select(
        F.col(id_col).cast("long").alias("id"), row_key(text_col).alias("x"), F.length(text_or_empty(text_col)).alias("chars"),
        hasher(normal).alias("h"), F.sha2(normal, 256).alias("sha")), "exact-digests")
    # Equal id, digests and length: the same document again. The smallest row key stands for it.
    units = digests.groupBy("id", "chars", "h", "sha").agg(F.min("x").alias("x"), F.count(F.lit(1)).alias("copies"))
    grouped = staged(_grouped(units.withColumn("rank", _rank("chars", "id")), "h"), "exact-groups")

    members = grouped.where(F.col("group_size") > F.col("copies"))
    unequal = staged(_unequal(_texts(docs, members, id_col, text_col)), "exact-collisions")
    if unequal.isEmpty():
        return grouped
    # Another text behind the same hash: such hashes are grouped by the text itself.
    good = grouped.join(unequal, "h", "left_anti")
    bad = grouped.join(unequal, "h", "left_semi").drop("group_size", "best")
    split = _grouped(_texts(docs, bad, id_col, text_col), "h", "normal")
    return staged(good.unionByName(split.drop("normal")), "exact-split")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                hasher: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    units = exact_units(docs, id_col, text_col, hasher)
    # Copies of one row come back as rows again; the first copy of the best row is the one that stays.
    copies = units.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return copies.select(
        F.col("id").alias("doc_id"), _ranked_id("best").alias("keep_id"), F.col("group_size").cast("long").alias("group_size"),
        ((F.col("rank") == F.col("best")) & (F.col("copy") == 1)).alias("kept"),
        F.col("sha").alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns."""
    kept = exact_units(docs, id_col, text_col).where(F.col("rank") == F.col("best"))
    repeated = not kept.where(F.col("copies") > 1).isEmpty()
    return keep_rows(docs, kept, repeated, id_col, text_col)

"""The prefix trie of rebuilt conversations, with subtree sums by centroid decomposition of the parent edges.

A conversation c is rebuilt from the first h turns of conversation c - c % 5 and its own turns after its first h, with
h = crc32(decimal c) % 9. Every distinct sequence of the first d turns (role, text) is a node; the root has no turn. Per node: smallest
member, members, children, childless nodes below, tokens that sharing saves, and a digest of the members that end there.

A node is known by its depth and the running sums of 128 hash bits of its turns, each hashed with its place, so a prefix needs no
text and its parent's name follows by subtraction. Nodes of a single conversation are a chain to one leaf and need no sums. The
others are cut into parts where the number of members crosses ``PART``, ``PART`` x ``FACTOR``, ... and every ``BAND`` turns of depth. Parts
are independent within a step, hold a bounded number of nodes and meet in cells; there ``centroids.subtree_sums`` decomposes them. The
total of a part's top is then added to the node it hangs from, in the part above.

Defined results: turns without number come first; turns of equal number go by role and text; null roles and texts are empty; turns
without conversation belong to none and take no part; a missing base adds nothing; the remainder has the sign of c, as in SQL; a
conversation that is rebuilt without turns is a member of the root only; repeated rows are turns of their own; extra columns are
ignored; an empty table gives an empty result.

Plan: texts are read once and leave the map side only for turns of equal number. Turns are numbered and hashed by running sums that
cut a hot conversation into slices. Hot nodes (the root, a common first turn) are partial aggregates or joins that adaptive execution
splits. The digest of a node streams its sorted members with constant state; it is one hash over one text, so the members of one node
are read in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import running_sums
from ..session import staged
from .centroids import subtree_sums

#: Conversations that share a base, and the modulus of the number of shared turns. Fixed values.
GROUP = 5
SHARED = 9
#: Members up to which nodes belong to the lowest parts, and the factor from one class of parts to the next.
PART = 1024
FACTOR = 1024
BAND = 1024
#: Nodes of a cell, on average; one part stays whole.
CELL = 65_536
KEY = ["d", "k1", "k2"]
_SUMS = ["a", "b", "x", "y"]


def _turns(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """c, pos (from 1), r1, r2 (hashes of role and text), bytes of the text."""
    given = conversations.select(
        F.col(conv_col).cast("long").alias("c"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text")).where(F.col("c").isNotNull())
    facts = [F.xxhash64(F.lit(n), "role", "text").alias(f"r{n}") for n in (1, 2)] + [F.octet_length("text").cast("long").alias("bytes")]
    tied = given.groupBy("c", "turn").count().where("count > 1").select(F.col("c").alias("tied_c"), F.col("turn").alias("tied_turn"))
    order = [F.asc_nulls_first("turn")]
    if tied.isEmpty():
        rows = given.select("c", "turn", *facts)
    else:
        on = (F.col("c") == F.col("tied_c")) & F.col("turn").eqNullSafe(F.col("tied_turn"))
        rows = given.join(tied, on, "left").select("c", "turn", *facts, F.when(F.col("tied_c").isNotNull(), F.struct("role", "text")).alias("tie"))
        order.append(F.asc_nulls_first("tie"))
    # Slices of a hot conversation follow the number of the turn.
    part = F.when(F.col("turn").isNull(), F.lit(-(1 << 62))).otherwise(F.shiftright("turn", 16))
    return staged(running_sums(rows, ["c"], order, {"pos": F.lit(1).cast("long")}, part).select("c", "pos", "r1", "r2", "bytes"), "trie-turns")


def _rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (c, total) and their turns (c, d, r1, r2, bytes)."""
    lengths = turns.groupBy("c").agg(F.max("pos").alias("own"))
    based = lengths.withColumn("h", F.pmod(F.crc32(F.col("c").cast("string")), F.lit(SHARED))).withColumn("base", F.col("c") - F.col("c") % GROUP)
    bases = lengths.select(F.col("c").alias("base_c"), F.col("own").alias("base_own"))
    convs = staged(based.join(bases, F.col("base") == F.col("base_c"), "left").select(
        "c", "h", "base", F.least("h", F.coalesce("base_own", F.lit(0))).alias("cut"), "own").withColumn(
        "total", F.col("cut") + F.greatest(F.col("own") - F.col("h"), F.lit(0))), "trie-conversations")
    first = turns.where((F.col("pos") < SHARED) & (F.col("c") % GROUP == 0)).withColumnRenamed("c", "base_c")
    head = convs.join(first, (F.col("base") == F.col("base_c")) & (F.col("pos") <= F.col("h"))).select("c", F.col("pos").alias("d"), "r1", "r2", "bytes")
    tail = turns.join(convs.select(F.col("c").alias("own_c"), "h", "cut"), (F.col("c") == F.col("own_c")) & (F.col("pos") > F.col("h"))).select(
        "c", (F.col("cut") + F.col("pos") - F.col("h")).alias("d"), "r1", "r2", "bytes")
    return convs, head.unionAll(tail)


def _name(depth: Column, sums: list[Column]) -> list[Column]:
    return [F.xxhash64(depth, sums[0], sums[1]), F.xxhash64(sums[2], sums[3], depth)]


def _paths(rows: DataFrame) -> DataFrame:
    """c, d, bytes, the name (k1, k2) of the node reached there and that of its parent (p1, p2)."""
    low = F.lit((1 << 32) - 1)
    hashed = rows.select("c", "d", "bytes", F.xxhash64("d", "r1").alias("u"), F.xxhash64("d", "r2").alias("v")).select(
        "c", "d", "bytes", F.shiftrightunsigned("u", 32).alias("ha"), F.col("u").bitwiseAND(low).alias("hb"), F.shiftrightunsigned("v", 32).alias("hx"),
        F.col("v").bitwiseAND(low).alias("hy"))
    summed = running_sums(hashed, ["c"], [F.asc("d")], {s: F.col(f"h{s}") for s in _SUMS}, F.shiftright("d", 16))
    own, above = [F.col(s) for s in _SUMS], [F.col(s) - F.col(f"h{s}") for s in _SUMS]
    named = [*zip(("k1", "k2"), _name(F.col("d"), own)), *zip(("p1", "p2"), _name(F.col("d") - 1, above))]
    return staged(summed.select("c", "d", "bytes", *[value.alias(name) for name, value in named]), "trie-paths")


def _ends(convs: DataFrame, paths: DataFrame, root: list[Column]) -> DataFrame:
    """Digest of the ids that end at a node, for nodes where any does."""
    last = paths.groupBy("c").agg(F.max(F.struct(*KEY)).alias("last")).select("c", *[F.col(f"last.{k}").alias(k) for k in KEY])
    none = convs.where(F.col("total") == 0).select("c", F.lit(0).cast("long").alias("d"), *root)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for batch in batches:
            found = []
            for here in zip(batch["d"].tolist(), batch["k1"].tolist(), batch["k2"].tolist(), batch["c"].tolist()):
                if here[:3] == key:
                    state.update(b",%d" % here[3])
                else:
                    if key:
                        found.append((*key, state.hexdigest()))
                    key, state = here[:3], hashlib.sha256(b"%d" % here[3])
            yield pd.DataFrame(found, columns=[*KEY, "ends"])
        if key:
            yield pd.DataFrame([(*key, state.hexdigest())], columns=[*KEY, "ends"])

    return last.unionAll(none).repartition("k1", "k2").sortWithinPartitions(*KEY, "c").mapInPandas(run, "d long, k1 long, k2 long, ends string")


def _cell_sums(cell: pd.DataFrame) -> pd.DataFrame:
    """leaves and saved of the nodes of whole parts, summed over what is below them in their part."""
    here = cell[["k1", "k2"]].assign(at=np.arange(len(cell)))
    at = cell[["p1", "p2"]].merge(here, how="left", left_on=["p1", "p2"], right_on=["k1", "k2"])["at"].fillna(-1).to_numpy(np.int64)
    at[cell["is_top"].to_numpy(bool)] = -1
    sums = subtree_sums(at, cell[["leaves", "saved"]].to_numpy(np.int64))
    return cell[["d", "k1", "k2", "p1", "p2", "is_top"]].assign(leaves=sums[:, 0], saved=sums[:, 1])


def _sums(nodes: DataFrame, paths: DataFrame, children: DataFrame, part: int, factor: int, band: int, cell: int) -> DataFrame:
    """d, k1, k2, leaves, saved of the nodes with more than one member."""
    limit, most, kind = part, nodes.agg(F.max("n_convs")).first()[0] or 0, F.lit(1)
    level = 1
    while limit < most:
        level += 1
        kind = F.when(F.col("n_convs") > limit, F.lit(level)).otherwise(kind)
        limit *= factor
    placed = nodes.where("n_convs > 1").withColumns({"kind": kind, "band": F.floor(F.col("d") / band)})
    # The first node of a path in its part is the part's top; the path of the smallest member stands for the node.
    on_path = paths.select("c", *KEY).join(placed.select(*KEY, "kind", "band"), KEY).select("c", "kind", "band", *KEY)
    with_root = on_path.unionAll(placed.where("d = 0").select(F.col("conv_id").alias("c"), "kind", "band", *KEY))
    tops = with_root.groupBy("c", "kind", "band").agg(F.min(F.struct(*KEY)).alias("top")).select(F.col("c").alias("conv_id"), "kind", "band", "top")
    # The root is on every path, but only its smallest member's path holds it here.
    root = placed.where("d = 0").select("kind", "band", F.struct(*KEY).alias("root_top"))
    topped = placed.join(tops, ["conv_id", "kind", "band"]).join(F.broadcast(root), ["kind", "band"], "left").withColumn(
        "top", F.coalesce("root_top", "top"))  # one row
    work = staged(topped.join(children, KEY, "left").select(
        *KEY, "p1", "p2", "kind", "band", "top", (F.struct(*KEY) == F.col("top")).alias("is_top"),
        F.when(F.col("n_children").isNull(), F.lit(1)).otherwise(F.lit(0)).cast("long").alias("own_leaves"),
        ((F.col("n_convs") - 1) * F.coalesce("bytes", F.lit(0))).alias("own_saved")), "trie-parts")
    # A conversation's own nodes are one chain; its leaf hangs from the last node it shares.
    chains = nodes.where("n_convs = 1").groupBy("conv_id").agg(F.min(F.struct("d", "p1", "p2")).alias("first")).where("first.d > 0").select(
        F.col("first.p1").alias("h1"), F.col("first.p2").alias("h2"))
    hanging = staged(chains.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("more_leaves"), F.lit(0).cast("long").alias("more_saved")), "trie-hanging")
    found = None
    # One step per class of parts and band of depth.
    for step in sorted(work.groupBy("kind", "band").count().collect(), key=lambda r: (-r.band, r.kind)):
        mine = work.where((F.col("kind") == step.kind) & (F.col("band") == step.band))
        more = hanging.groupBy("h1", "h2").agg(F.sum("more_leaves").alias("more_leaves"), F.sum("more_saved").alias("more_saved"))
        valued = mine.join(more, (F.col("k1") == F.col("h1")) & (F.col("k2") == F.col("h2")), "left").select(
            *KEY, "p1", "p2", "is_top", (F.col("own_leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"),
            (F.col("own_saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"),
            F.pmod(F.xxhash64("top"), F.lit(max(1, -(-2 * step["count"] // cell)))).alias("cell"))
        summed = staged(valued.groupBy("cell").applyInPandas(
            _cell_sums, "d long, k1 long, k2 long, p1 long, p2 long, is_top boolean, leaves long, saved long"), "trie-sums")
        up = summed.where("is_top AND d > 0").groupBy(F.col("p1").alias("h1"), F.col("p2").alias("h2")).agg(
            F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        hanging = hanging.unionAll(staged(up, "trie-hanging"))
        result = summed.select(*KEY, "leaves", "saved")
        found = result if found is None else found.unionAll(result)
    return found


def conversation_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                      part: int = PART, factor: int = FACTOR, band: int = BAND, cell: int = CELL) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    convs, rows = _rebuilt(_turns(conversations, conv_col, turn_col, role_col, text_col))
    paths = _paths(rows)
    zero = F.lit(0).cast("long")
    root = [value.alias(name) for name, value in zip(("k1", "k2"), _name(zero, [zero] * 4))]
    none = F.lit(None).cast("long")
    top = convs.agg(F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(
        zero.alias("d"), *root, "conv_id", "n_convs", zero.alias("bytes"), none.alias("p1"), none.alias("p2"))
    nodes = staged(paths.groupBy(*KEY).agg(
        F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("bytes").alias("bytes"), F.min("p1").alias("p1"),
        F.min("p2").alias("p2")).unionAll(top), "trie-nodes")
    children = staged(nodes.where("d > 0").groupBy((F.col("d") - 1).alias("d"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(
        F.count(F.lit(1)).alias("n_children")), "trie-children")
    sums = _sums(nodes, paths, children, part, factor, band, cell)
    ends = staged(_ends(convs, paths, root), "trie-ends")
    whole = nodes.join(children, KEY, "left").join(ends, KEY, "left")
    if sums is None:
        whole = whole.withColumns({"leaves": none, "saved": none})
    else:
        whole = whole.join(sums, KEY, "left")
    above = nodes.select(F.col("k1").alias("up1"), F.col("k2").alias("up2"), F.col("conv_id").alias("parent_conv_id"))
    return whole.join(above, (F.col("p1") == F.col("up1")) & (F.col("p2") == F.col("up2")), "left").select(
        "conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"),
        F.coalesce("leaves", F.lit(1).cast("long")).alias("n_leaves"), F.coalesce("saved", zero).alias("saved_tokens"),
        F.coalesce("ends", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))

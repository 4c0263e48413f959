"""Vantage-point trees over 64-bit fingerprints: distributed shards, local pruning, exact pairs.

A pair within ``distance`` bits differs by at most ``distance // blocks`` bits in one of ``blocks`` groups of bits. Hamming
distance inside a group of bits is a metric of its own, so each group gets its own vantage-point tree with that smaller
radius: far fewer branches lie within the radius of a boundary than for the whole fingerprint.

The upper part of each tree is built from a bounded sample and only decides how fingerprints are dealt to shards. A
fingerprint lives in one leaf of each tree and visits every leaf the triangle inequality cannot exclude. Inside a shard the
same recursion goes on over the data of the shard, down to blocks in which all distances are computed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np


def masks(blocks: int) -> list[int]:
    """Groups of neighbouring bits that cover all 64."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]


def _split(values: np.ndarray, mask: np.uint64, rng: np.random.Generator, tries: int = 4):
    """The vantage point and radius with the most even split among a few candidates, or None."""
    best = None
    for vantage in rng.choice(values, size=tries):
        d = np.bitwise_count((values ^ vantage) & mask)
        radius = int(np.median(d))
        inside = np.count_nonzero(d <= radius)
        if inside == len(d):  # the median may be the largest distance
            radius -= 1
            inside = np.count_nonzero(d <= radius)
        evenness = min(inside, len(d) - inside)
        if evenness and (best is None or evenness > best[0]):
            best = (evenness, vantage, radius)
    return best and best[1:]


@dataclass
class Tree:
    """Arrays of nodes; a leaf has radius -1 and its number in ``left``."""

    mask: int
    vantage: np.ndarray
    radius: np.ndarray
    left: np.ndarray
    right: np.ndarray
    leaves: int

    @classmethod
    def build(cls, sample: np.ndarray, mask: int, depth: int, seed: int = 7) -> Tree:
        rng, nodes, leaves = np.random.default_rng(seed), [], 0
        todo = [(sample, depth, -1, 0)]
        while todo:
            values, deep, parent, side = todo.pop()
            at = len(nodes)
            if parent >= 0:
                nodes[parent][2 + side] = at
            cut = _split(values, np.uint64(mask), rng) if deep and len(values) > 1 else None
            if cut is None:
                nodes.append([0, -1, leaves, 0])
                leaves += 1
                continue
            nodes.append([int(cut[0]), cut[1], 0, 0])
            inside = np.bitwise_count((values ^ cut[0]) & np.uint64(mask)) <= cut[1]
            todo += [(values[~inside], deep - 1, at, 1), (values[inside], deep - 1, at, 0)]
        columns = list(zip(*nodes))
        return cls(mask, np.array(columns[0], dtype=np.uint64), *(np.array(c, dtype=np.int64) for c in columns[1:]), leaves)

    def route(self, values: np.ndarray, reach: int) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, positions of the values that visit it); reach 0 gives each value's home only."""
        todo = [(0, np.arange(len(values)))]
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            radius = self.radius[node]
            if radius < 0:
                yield int(self.left[node]), at
                continue
            d = np.bitwise_count((values[at] ^ self.vantage[node]) & np.uint64(self.mask)).astype(np.int64)
            todo.append((self.left[node], at[d <= radius + reach]))
            todo.append((self.right[node], at[d > radius - reach]))


class Forest:
    """Sets of positions that merge; the smallest member is the root."""

    def __init__(self, size: int):
        self.parent = np.arange(size)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.parent[a], self.parent[b]
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.parent, np.maximum(ra, rb), np.minimum(ra, rb))
            self._flatten()

    def _flatten(self) -> None:
        while True:
            up = self.parent[self.parent]
            if np.array_equal(up, self.parent):
                return
            self.parent = up


def linked(values: np.ndarray, home: np.ndarray, mask: int, reach: int, distance: int, small: int = 256) -> np.ndarray:
    """For sorted distinct ``values``, the position of the smallest value each is connected with.

    Pairs of a value that lives here (``home``) with any value within ``reach`` in the masked bits are compared exactly;
    they join sets as they are found and are never listed.
    """
    forest, bits, rng = Forest(len(values)), np.uint64(mask), np.random.default_rng(3)
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    pending = 0
    todo = [(np.nonzero(home)[0], np.arange(len(values)))]
    while todo:
        own, guests = todo.pop()
        if not len(own) or not len(guests):
            continue
        cut = _split(values[own], bits, rng, 2) if len(own) > small else None
        if cut is None:
            for start in range(0, len(own), 1024):
                tile = own[start:start + 1024]
                for low in range(0, len(guests), 256):
                    part = guests[low:low + 256]
                    near = np.bitwise_count(values[part][:, None] ^ values[tile][None, :]) <= distance
                    i, j = np.nonzero(near)
                    a, b = part[i], tile[j]
                    apart = a != b
                    waiting.append((a[apart], b[apart]))
                    pending += len(waiting[-1][0])
                    if pending > 200_000:
                        forest.join(*(np.concatenate(x) for x in zip(*waiting)))
                        waiting, pending = [], 0
            continue
        vantage, radius = cut
        d_own = np.bitwise_count((values[own] ^ vantage) & bits).astype(np.int64)
        d_guests = np.bitwise_count((values[guests] ^ vantage) & bits).astype(np.int64)
        todo.append((own[d_own <= radius], guests[d_guests <= radius + reach]))
        todo.append((own[d_own > radius], guests[d_guests > radius - reach]))
    if waiting:
        forest.join(*(np.concatenate(x) for x in zip(*waiting)))
    return forest.parent

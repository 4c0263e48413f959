"""Sums over subtrees of a forest by centroid decomposition of its parent edges.

Each component is cut at its centroid: the deepest node that still has half of the component's nodes below it. The totals of the
parts below the centroid are aggregated by component, and their sum is added to every node on the path from the centroid to the
top of its component. Then the parts are cut in turn. A part has at most half the nodes of what it was cut from, so a forest is
done after log2(nodes) rounds whatever its depth, and a node and its descendant meet in exactly one cut. All components go through a
round together.
"""

from __future__ import annotations

import numpy as np


def _tops(up: np.ndarray) -> np.ndarray:
    """The top of the component of each node, by doubling the steps; ``up`` is -1 above a top."""
    top = np.where(up < 0, np.arange(len(up)), up)
    while True:
        above = top[top]
        if np.array_equal(above, top):
            return top
        top = above


def _sizes(up: np.ndarray) -> np.ndarray:
    """Nodes of each subtree: the ends of all paths are counted level by level."""
    size, open_children, rest = np.ones(len(up), np.int64), np.bincount(up[up >= 0], minlength=len(up)), up >= 0
    ready = np.nonzero(open_children == 0)[0]
    while len(ready):
        ready = ready[rest[ready]]
        above = up[ready]
        np.add.at(size, above, size[ready])
        np.subtract.at(open_children, above, 1)
        above = np.unique(above)
        ready = above[open_children[above] == 0]
    return size


def subtree_sums(parent: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Per node the sum of the rows of ``values`` over its subtree, itself included; ``parent`` is -1 for a top."""
    up, total = np.array(parent, dtype=np.int64), np.array(values, dtype=np.int64)
    size, done = _sizes(up), np.zeros(len(up), bool)
    top = _tops(up)
    while not done.all():
        heavy = ~done & (2 * size >= size[top])
        inner = np.zeros(len(up), bool)
        inner[up[heavy & (up >= 0)]] = True
        centre = np.nonzero(heavy & ~inner)[0]  # one of each component: heavy nodes are a chain from its top
        above = up[centre]
        is_centre = np.zeros(len(up), bool)
        is_centre[centre] = True
        below = np.nonzero((up >= 0) & is_centre[up])[0]
        owner = up[below]
        up[below], up[centre], done[centre] = -1, -1, True
        top = _tops(up)
        of_part = np.zeros_like(total)
        np.add.at(of_part, top[~done], np.asarray(values)[~done])
        np.add.at(total, owner, of_part[below])
        gain = np.array(values, dtype=np.int64)[centre]
        at = np.full(len(up), -1)
        at[centre] = np.arange(len(centre))
        np.add.at(gain, at[owner], of_part[below])
        lost = size[centre]
        while len(above):  # one walker per component, so no two meet
            going = above >= 0
            above, gain, lost = above[going], gain[going], lost[going]
            total[above] += gain
            size[above] -= lost
            above = up[above]
    return total

"""Product quantisation in numpy: coarse lists, residual codes per subspace, distances by table lookup."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Distances computed at a time, few enough to stay in a core's cache.
BLOCK = 1 << 17


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision; scaled first, so no square over- or underflows."""
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def nearest(rows: np.ndarray, centres: np.ndarray, count: int = 1) -> np.ndarray:
    """The ``count`` nearest centres of each row, nearest first; ties go to the smaller number."""
    out = np.empty((len(rows), count), dtype=np.int64)
    half = (centres * centres).sum(axis=1) / 2
    step = max(1, BLOCK // len(centres))
    for low in range(0, len(rows), step):
        far = half - rows[low:low + step] @ centres.T
        if count == 1:
            out[low:low + step, 0] = far.argmin(axis=1)
        else:
            out[low:low + step] = _least(far, count)
    return out


def _least(far: np.ndarray, count: int) -> np.ndarray:
    """The columns of the ``count`` least values of each row in order, without sorting the others."""
    part = np.sort(np.argpartition(far, count - 1, axis=1)[:, :count], axis=1)
    value = np.take_along_axis(far, part, axis=1)
    out = np.take_along_axis(part, np.argsort(value, axis=1, kind="stable"), axis=1)
    tied = (far <= value.max(axis=1, keepdims=True)).sum(axis=1) > count
    out[tied] = np.argsort(far[tied], axis=1, kind="stable")[:, :count]
    return out


def k_means(rows: np.ndarray, count: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = rows[rng.permutation(len(rows))[:count]].copy()
    for _ in range(rounds):
        home = nearest(rows, centres)[:, 0]
        size = np.bincount(home, minlength=len(centres))
        total = np.stack([np.bincount(home, rows[:, d], len(centres)) for d in range(rows.shape[1])], axis=1)
        filled = size > 0
        centres[filled] = total[filled] / size[filled, None]
    return centres


@dataclass
class Quantiser:
    centres: np.ndarray  # (lists, dimensions)
    edges: np.ndarray  # borders of the subspaces
    books: list[np.ndarray]  # per subspace (codes, width)

    @classmethod
    def train(cls, sample: np.ndarray, lists: int, subspaces: int = 8, codes: int = 256, rounds: int = 8, seed: int = 5) -> Quantiser:
        """``sample`` holds unit rows. They are fitted in single precision, which is half the work; any centres and codes are right."""
        rng, sample = np.random.default_rng(seed), sample.astype(np.float32)
        centres = k_means(sample, min(lists, len(sample)), rounds, rng)
        residual = sample - centres[nearest(sample, centres)[:, 0]]
        edges = np.linspace(0, sample.shape[1], min(subspaces, sample.shape[1]) + 1).astype(int)
        books = [k_means(residual[:, a:b], min(codes, len(sample)), rounds, rng) for a, b in zip(edges, edges[1:])]
        return cls(centres.astype(np.float64), edges, [book.astype(np.float64) for book in books])

    def encode(self, rows: np.ndarray, home: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals in one list, and the least product with a decoded row that lets the row's cosine reach the threshold.

        Two bounds, the larger counts: the product is off by no more than the length of what the codes leave out, and the angle to the
        decoded row by no more than the angle between the row and the decoded row.
        """
        decoded = np.repeat(self.centres[home][None], len(rows), axis=0)
        codes = np.empty((len(rows), len(self.books)), dtype=np.int16)
        for n, (a, b) in enumerate(zip(self.edges, self.edges[1:])):
            codes[:, n] = nearest(rows[:, a:b] - decoded[:, a:b], self.books[n])[:, 0]
            decoded[:, a:b] += self.books[n][codes[:, n]]
        error, length = (np.sqrt((x * x).sum(axis=1)) for x in (rows - decoded, decoded))
        cosine = (rows * decoded).sum(axis=1) / np.maximum(length, 1e-300)
        angle = np.arccos(np.clip(cosine, -1, 1)) + np.arccos(np.clip(threshold, -1, 1))
        return codes, np.maximum(threshold - error, length * np.cos(np.minimum(angle, np.pi)))

    def tables(self, queries: np.ndarray) -> list[np.ndarray]:
        """Per subspace the products of each code (rows) with each query (columns), in single precision."""
        queries = queries.astype(np.float32)
        return [book.astype(np.float32) @ queries[:, a:b].T for a, b, book in zip(self.edges, self.edges[1:], self.books)]

"""Toxicity of whole texts: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is a run of letters and digits in lower case. Its features are the word and its character n-grams of three to five
characters with word ends marked, hashed to ``BUCKETS`` rows of an embedding table. The embeddings of all features in a window
of ``WINDOW`` words are averaged, and a linear layer with softmax gives the window's probability of label 1; a text scores as
its most toxic window, so a long text cannot hide a passage. Embeddings and layer are trained together: first on whole texts,
then on the window that scores highest at the time. An unseen misspelling shares most n-grams with words the training saw. Every
fifth labelled text is kept back to set temperature and bias of the softmax.

Labels are learned only from rows whose crc32(doc_id as text) mod 3 is not 1, at most ``POSITIVES`` and ``NEGATIVES`` of them,
chosen by a hash of the id; texts of over ``LONGEST`` code points are not learned from. Id, labels, language and source are no
inputs of a score. Scoring reads every text whole.

Defined results: a null text counts as empty; a text without words gets the score of the bias alone; a document whose id is
null is never learned from and not held out; a label row with nulls is left out; several labels of a document count as toxic
if one is; repeated rows get equal scores; without labelled rows of both classes every score is 0.5; extra columns are ignored;
an empty table gives an empty result.

Plan: the sample of ids is bounded and broadcast, its texts are the only rows that reach the driver. One pass over documents
fetches the sample, a second one scores. The trained table, one number per bucket, is broadcast. Only labels are shuffled.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import give_back
from .rows import fresh, text_or_empty

BUCKETS = 1 << 16
DIMENSIONS = 8
GRAMS = (3, 4, 5)
WINDOW = 16
POSITIVES = 2000
NEGATIVES = 3000
LONGEST = 200_000
THRESHOLD = 0.7
CACHE = 100_000
#: A window averages over at least so many features, so a few words alone stay near the bias.
LEAST = 64
#: Averages of thousands of features are small; the layer sees them times this factor.
GAIN = 100.0

WORDS = regex.compile(r"[\p{L}\p{N}\p{M}]+")


def words(text: str) -> list[str]:
    """Words in order; one that follows itself counts once, else a line of one word repeated would be a window of its own."""
    return [w for w, _ in groupby(WORDS.findall(text.lower()))]


def features(word: str, buckets: int = BUCKETS) -> list[int]:
    """Buckets of the word and its n-grams."""
    marked = f"<{word}>"
    grams = [marked] + [marked[i:i + n] for n in GRAMS if n < len(marked) for i in range(len(marked) - n + 1)]
    return [zlib.crc32(g.encode()) % buckets for g in grams]


def window_edges(size: int, window: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of half-overlapping windows over ``size`` words; at least one window."""
    if window is None or size <= window:
        return np.zeros(1, np.int64), np.full(1, size, np.int64)
    starts = np.arange(0, size - window // 2, window // 2)
    return starts, np.minimum(starts + window, size)


@dataclass
class Model:
    """Embeddings, layer and bias; ``temperature`` and ``shift`` come from the texts kept back."""

    embeddings: np.ndarray
    layer: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    shift: float = 0.0

    def table(self) -> tuple[np.ndarray, float]:
        """What one feature adds to the difference of both classes, and the rest. Average and layer are linear, so they change
        places."""
        slope = (self.embeddings @ (self.layer[:, 1] - self.layer[:, 0])) * (GAIN * self.temperature)
        return slope.astype(np.float64), float(self.bias[1] - self.bias[0]) * self.temperature + self.shift


class _Sample:
    """Labelled texts as word numbers; features are stored once per word."""

    def __init__(self, texts: list[str], buckets: int):
        numbers: dict[str, int] = {}
        self.texts = [np.array([numbers.setdefault(w, len(numbers)) for w in words(t)], dtype=np.int32) for t in texts]
        at, size = array("i"), array("q")
        for word in numbers:
            found = features(word, buckets)
            at.extend(found)
            size.append(len(found))
        del numbers
        self.size, self.at = np.frombuffer(size, dtype=np.int64), np.frombuffer(at, dtype=np.int32)
        self.first = np.concatenate(([0], np.cumsum(self.size)[:-1])).astype(np.int64)
        self.all = np.concatenate(self.texts) if self.texts else np.empty(0, np.int32)
        self.count = np.concatenate(([0], np.cumsum(self.size[self.all])))

    def windows(self, window: int | None):
        """Starts, ends and number of the text of each window, and the first window of each text."""
        starts, ends, owner, first, offset, total = [], [], [], [], 0, 0
        for n, text in enumerate(self.texts):
            a, b = window_edges(len(text), window)
            starts.append(a + offset)
            ends.append(b + offset)
            owner.append(np.full(len(a), n))
            first.append(total)
            offset += len(text)
            total += len(a)
        return np.concatenate(starts), np.concatenate(ends), np.concatenate(owner), np.array(first)

    def _parts(self):
        """Ranges of words and of their features; arrays of all features at once would be most of the driver's memory."""
        for low in range(0, len(self.size), PART):
            high = min(low + PART, len(self.size))
            yield slice(low, high), slice(self.first[low], self.first[high - 1] + self.size[high - 1])

    def best(self, slope: np.ndarray, edges) -> tuple[np.ndarray, np.ndarray]:
        """Number and average of the highest window of each text."""
        starts, ends, owner, first = edges
        per_word = np.zeros(len(self.size))
        for words_, at in self._parts():
            per_word[words_] = np.add.reduceat(slope[self.at[at]], self.first[words_] - self.first[words_.start])
        running = np.concatenate(([0.0], np.cumsum(per_word[self.all], dtype=np.float64)))
        mean = (running[ends] - running[starts]) / np.maximum(LEAST, self.count[ends] - self.count[starts])
        top = np.maximum.reduceat(mean, first)
        hits = np.nonzero(mean == top[owner])[0]
        _, one = np.unique(owner[hits], return_index=True)
        return hits[one], top

    def spread(self, chosen: np.ndarray, edges, error: np.ndarray, buckets: int) -> np.ndarray:
        """Sum per bucket of the error of each chosen window, shared by the window's features."""
        starts, ends = edges[0][chosen], edges[1][chosen]
        length = ends - starts
        share = error / np.maximum(LEAST, self.count[ends] - self.count[starts])
        at = np.repeat(starts - np.concatenate(([0], np.cumsum(length)[:-1])), length) + np.arange(length.sum())
        per_word = np.bincount(self.all[at], np.repeat(share, length), len(self.size))
        out = np.zeros(buckets)
        for words_, features_ in self._parts():
            out += np.bincount(self.at[features_], np.repeat(per_word[words_], self.size[words_]), buckets)
        return out


def _probability(score: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(score, -500, 500)))


def _calibrate(score: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Temperature and shift by Newton steps on the weighted log loss, drawn towards 1 and 0."""
    x, theta, prior = np.stack([score, np.ones_like(score)], axis=1), np.array([1.0, 0.0]), np.diag([1.0, 0.1])
    for _ in range(50):
        p = _probability(x @ theta)
        grad = x.T @ (weight * (p - label)) + prior @ (theta - [1.0, 0.0])
        step = np.linalg.solve((x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + prior, grad)
        theta = theta - np.clip(step, -1, 1)
    return float(max(theta[0], 0.05)), float(theta[1])


def train(texts: list[str], labels: np.ndarray, negatives_per_sampled: float = 1.0, buckets: int = BUCKETS,
          dimensions: int = DIMENSIONS, window: int = WINDOW, whole_rounds: int = 100, window_rounds: int = 70, rate: float = 0.1,
          seed: int = 11) -> Model:
    """Gradient descent with momentum on the log loss of both classes; embeddings, layer and bias move together.

    ``negatives_per_sampled`` is how many negative rows stand behind one that was sampled; calibration uses it as weight.
    """
    rng, labels = np.random.default_rng(seed), np.asarray(labels, dtype=np.float64)
    direction = rng.normal(0, 1, dimensions)
    direction /= np.linalg.norm(direction)
    model = Model(rng.normal(0, 0.01, (buckets, dimensions)), np.stack([-direction / 2, direction / 2], axis=1), np.array([1.0, -1.0]))
    learn = np.arange(len(labels)) % 5 != 4  # rows come in an order that has nothing to do with labels
    if not len(texts) or len(np.unique(labels[learn])) < 2:
        return Model(np.zeros((buckets, dimensions)), model.layer, np.zeros(2))
    sample, per_row = _Sample(texts, buckets), learn / learn.sum()
    del texts  # the sample holds word numbers only
    give_back()
    for width, rounds in ((None, whole_rounds), (window, window_rounds)):
        edges, speed, last = sample.windows(width), [0.0, 0.0, 0.0], np.inf
        for _ in range(rounds):
            slope = (model.embeddings @ (model.layer[:, 1] - model.layer[:, 0]) * GAIN).astype(np.float32)
            chosen, mean = sample.best(slope, edges)
            p = _probability(mean + model.bias[1] - model.bias[0])
            loss = -(per_row * np.log(np.where(labels == 1, p, 1 - p) + 1e-12)).sum()
            if loss > max(1.0, 2 * last):  # diverges: smaller steps
                rate, speed = rate / 2, [0.0, 0.0, 0.0]
            last = loss
            error = per_row * (p - labels)
            at_bucket = sample.spread(chosen, edges, error * GAIN, buckets)
            by_layer = model.embeddings.T @ at_bucket
            grads = (np.outer(at_bucket, model.layer[:, 1] - model.layer[:, 0]), np.stack([-by_layer, by_layer], axis=1) / 2,
                     np.array([-error.sum(), error.sum()]) / 2)
            speed = [0.9 * s + g for s, g in zip(speed, grads)]
            model.embeddings -= rate * speed[0]
            model.layer -= rate * speed[1]
            model.bias -= rate * speed[2]
    kept = ~learn
    if len(np.unique(labels[kept])) == 2:
        slope, bias = model.table()
        _, mean = sample.best(slope, sample.windows(window))
        model.temperature, model.shift = _calibrate(
            mean[kept] + bias, labels[kept], np.where(labels[kept] == 1, 1.0, negatives_per_sampled))
    return model


def held_out(id_col: str | Column) -> Column:
    """Rows labels are never learned from."""
    column = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.pmod(F.crc32(column.cast("string")), F.lit(3)) == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        positives: int = POSITIVES, negatives: int = NEGATIVES, longest: int = LONGEST, **training) -> Model:
    """Trains on a bounded sample of the labelled rows that are not held out."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col)).groupBy(
        F.col(id_col).cast("long").alias("label_id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    chosen = [known.where(F.col("label") == F.lit(label)).orderBy(F.xxhash64("label_id"), "label_id").limit(bound)
              for label, bound in ((1, positives), (0, negatives))]
    sample = F.broadcast(chosen[0].unionAll(chosen[1]))  # at most positives + negatives rows
    found = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")).where(
        F.length("text") <= longest).join(sample, F.col("id") == F.col("label_id")).select("id", "label", "text")
    # Of rows that repeat an id the least text is taken, so at most positives + negatives rows arrive and reruns agree.
    rows = found.groupBy("id", "label").agg(F.min("text").alias("text")).toArrow().to_pandas()
    # The order decides which rows are kept back; it must depend on nothing but the rows.
    rows = rows.assign(place=[zlib.crc32(f"{i}/fold".encode()) for i in rows["id"]]).sort_values(["place", "id", "text"])
    taken = int((rows["label"] == 0).sum())
    behind = known.where("label = 0").count() / taken if taken else 1.0
    rows, columns = None, {name: rows[name].tolist() for name in ("text", "label")}
    give_back()
    model = train(columns.pop("text"), np.array(columns["label"]), max(1.0, behind), **training)
    give_back()
    return model


#: Table sums are whole multiples of one part in FINE, so a sum does not depend on what was added before it.
FINE = 1 << 32
#: Characters of the texts that are scored together.
CHUNK = 1 << 19
#: Words of the training sample whose features are looked at together.
PART = 1 << 15


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, np.uint32(0xEDB88320) ^ (table >> 1), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()


def _char_steps(points: np.ndarray) -> list[np.ndarray]:
    """The UTF-8 bytes of code points, first bytes first; 256 where a point has fewer."""
    size = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
    lead = np.choose(size - 1, [points, 0xC0 | points >> 6, 0xE0 | points >> 12, 0xF0 | points >> 18])
    steps = [lead]
    for n in range(1, int(size.max(initial=1))):
        # The n-th byte after the first holds six bits.
        steps.append(np.where(size > n, 0x80 | (points >> (6 * np.maximum(0, size - 1 - n)) & 63), 256))
    return steps


def word_sums(words_: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the table over the features of each word, and their number: ``features`` for many words at once."""
    lengths = np.fromiter(map(len, words_), np.int64, len(words_)) + 2
    steps = _char_steps(np.frombuffer("".join(f"<{w}>" for w in words_).encode("utf-32-le"), dtype=np.uint32).astype(np.int64))
    ends = np.cumsum(lengths)
    room, whole = np.repeat(ends, lengths) - np.arange(ends[-1]), np.repeat(lengths, lengths)
    state, found, counts = np.full(ends[-1], 0xFFFFFFFF, np.uint32), np.zeros(ends[-1], np.int64), np.ones(len(words_), np.int64)
    for n in range(1, max(GRAMS) + 1):
        state = state[:len(state) - (n > 1)]  # a gram that starts here has its n-th character n - 1 places on
        for step in steps:
            byte = step[n - 1:]
            after = _CRC[(state ^ byte.astype(np.uint32)) & np.uint32(255)] ^ (state >> np.uint32(8))
            state = after if step is steps[0] else np.where(byte < 256, after, state)
        if n in GRAMS:
            inside = np.nonzero((room[:len(state)] >= n) & (whole[:len(state)] > n))[0]
            found[inside] += table[(state[inside] ^ np.uint32(0xFFFFFFFF)) % np.uint32(len(table))]
            counts += np.where(lengths > n, lengths - n + 1, 0)
    own = np.fromiter((zlib.crc32(f"<{w}>".encode()) % len(table) for w in words_), np.int64, len(words_))
    return np.add.reduceat(found, ends - lengths) + table[own], counts


class Scorer:
    """Scores texts in batches; every distinct word of a batch is looked up once and kept for the next ones."""

    def __init__(self, table: np.ndarray, bias: float, window: int = WINDOW):
        self.table, self.bias, self.window = np.rint(table * FINE).astype(np.int64), bias, window
        self._forget()

    def _forget(self) -> None:
        self.numbers: dict[str, int] = {}
        self.sums, self.counts = np.empty(0, np.int64), np.empty(0, np.int64)

    def _chunk(self, texts: list[str]) -> np.ndarray:
        if len(self.numbers) > CACHE:
            self._forget()
        found, numbers = [WORDS.findall(t.lower()) for t in texts], self.numbers
        new = list(dict.fromkeys(w for text in found for w in text if w not in numbers))
        if new:
            numbers.update(zip(new, range(len(numbers), len(numbers) + len(new))))
            sums, counts = word_sums(new, self.table)
            self.sums, self.counts = np.concatenate((self.sums, sums)), np.concatenate((self.counts, counts))
        out, look = np.full(len(texts), self.bias), numbers.__getitem__
        for n, text in enumerate(found):
            if not text:
                continue
            at = np.fromiter(map(look, text), np.int64, len(text))
            at = at[np.concatenate(([True], at[1:] != at[:-1]))]  # a word that follows itself counts once
            starts, ends = window_edges(len(at), self.window)
            total, count = (np.concatenate(([0], np.cumsum(x[at]))) for x in (self.sums, self.counts))
            out[n] += ((total[ends] - total[starts]) / FINE / np.maximum(LEAST, count[ends] - count[starts])).max()
        return out

    def score(self, texts) -> np.ndarray:
        """Probability of label 1 per text."""
        parts, waiting, size = [np.empty(0)], [], 0
        for text in texts:
            waiting.append(text)
            size += len(text)
            if size >= CHUNK:
                parts.append(self._chunk(waiting))
                waiting, size = [], 0
        return _probability(np.concatenate([*parts, self._chunk(waiting)]))


def with_score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score", window: int = WINDOW) -> DataFrame:
    """All columns and the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model.table())

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(*shared.value, window)
        for texts in batches:
            yield pd.Series(scorer.score(texts))

    return docs.withColumn(score_col, run(text_or_empty(text_col)))


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **bounds) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scored = with_score(own, fit(docs, labels, id_col, text_col, **bounds))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **bounds) -> DataFrame:
    """The documents that score below the threshold, with all their columns."""
    score = fresh(docs.columns, "_score")
    return with_score(docs, fit(docs, labels, id_col, text_col, **bounds), text_col, score).where(F.col(score) < THRESHOLD).drop(score)

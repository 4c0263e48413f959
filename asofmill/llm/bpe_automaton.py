"""A byte-pair encoding compiled into a deterministic automaton by successive merge gadgets (Berglund et al., 2024).

The automaton reads token labels and accepts exactly the token sequences the merges produce. It starts as one state with a
loop for every base symbol. The gadget of a merge (a, b) -> c goes through every state with a path a b: the state behind a
is split off without its arc b, and the state before gets an arc c to where the path led. All arcs of one label lead to the
same state, so a state is named by its label and the automaton is a matrix of bits "label may follow state":

* behind c the automaton is where it was behind b: the row of state c is a copy of the row of b;
* c can be read where a can be read and b could follow: the column of label c is a copy of the column of a;
* b no longer follows a: one bit is cleared.

Labels that end a word have no arcs behind them, so only the others have a row. Equal rows and equal columns are stored once.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

import numpy as np


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable bytes stand for themselves,
    the others follow from code point 256 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


def _turned(bits: np.ndarray, width: int, step: int = 1024) -> np.ndarray:
    """The transposed matrix of bits, ``width`` rows, made in strips of ``step`` rows."""
    strips = [np.packbits(np.unpackbits(bits[:, low // 8:(low + step) // 8], axis=1, bitorder="little").T, axis=1, bitorder="little")
              for low in range(0, bits.shape[1] * 8, step)]
    return np.vstack(strips)[:width]


def _distinct(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each different row once, in order of appearance, and the place of every row among them; compares 256-bit digests, so the
    matrix is not copied for sorting."""
    places: dict[bytes, int] = {}
    of = np.array([places.setdefault(hashlib.sha256(row.tobytes()).digest(), len(places)) for row in bits], dtype=np.int64)
    _, first = np.unique(of, return_index=True)
    return bits[first], of


@dataclass
class Automaton:
    """``allowed[column[label], row[state] // 8]`` holds the bit; row ``start`` allows every label."""

    labels: list[str]
    suffix: str
    row: np.ndarray
    column: np.ndarray
    allowed: np.ndarray
    longest: int
    start: int = 0
    inner: dict[str, tuple[int, bytes, int]] = field(default_factory=dict)  # labels inside a word
    final: dict[str, tuple[int, bytes, int]] = field(default_factory=dict)  # labels that end a word, without the suffix

    @classmethod
    def compile(cls, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str) -> Automaton:
        labels = [""] * (max(vocab.values()) + 1)
        for text, number in vocab.items():
            labels[number] = text
        steps = [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges]
        made = {c for _, _, c in steps}
        ends = np.array([bool(suffix) and t.endswith(suffix) for t in labels])
        states = np.full(len(labels), -1)
        order = [n for n in range(len(labels)) if labels[n] and n not in made] + [c for _, _, c in steps]
        if len(order) != len(set(order)):
            raise ValueError("two merges make the same token")
        inner = [n for n in order if not ends[n]]
        states[inner] = np.arange(len(inner))
        place = np.empty(len(labels), dtype=np.int64)  # columns in order of creation, so that living columns are a prefix
        place[order] = np.arange(len(order))
        bits = np.zeros((len(order), (len(inner) + 7) // 8), dtype=np.uint8)
        alive = len(order) - len(steps)
        base_states = [states[n] for n in order[:alive] if states[n] >= 0]
        first = np.zeros(bits.shape[1] * 8, dtype=np.uint8)
        first[base_states] = 1
        bits[:alive] = np.packbits(first, bitorder="little")
        for a, b, c in steps:
            sa = states[a]
            if place[a] >= alive or place[b] >= alive:
                raise ValueError(f"a merge uses {labels[a]!r} or {labels[b]!r} before it is made")
            if sa < 0 or not bits[place[b], sa >> 3] >> (sa & 7) & 1:
                alive += 1  # no path a b: the token is never read
                continue
            if states[c] >= 0:
                sc, sb = states[c], states[b]
                behind_b = bits[:alive, sb >> 3] >> np.uint8(sb & 7) & np.uint8(1)
                bits[:alive, sc >> 3] |= behind_b << np.uint8(sc & 7)
            bits[place[b], sa >> 3] &= 255 ^ (1 << (sa & 7))
            bits[alive] = bits[place[a]]
            alive += 1
        columns, column_of = _distinct(bits)
        del bits
        rows, row_of = _distinct(_turned(columns, len(inner)))
        everything = np.full((1, rows.shape[1]), 255, dtype=np.uint8)
        allowed = _turned(np.vstack([rows, everything]), len(columns))
        row = np.full(len(labels) + 1, -1)
        row[inner] = row_of
        row[-1] = len(rows)  # the start
        column = np.zeros(len(labels), dtype=np.int64)
        column[order] = column_of
        return cls(labels, suffix, row.astype(np.int32), column.astype(np.int32), allowed,
                   max(len(t.removesuffix(suffix)) if suffix else len(t) for t in labels))

    def _index(self) -> None:
        """Per label what reading it takes: its number, the states that allow it, the state it leads to.

        Made for the first word, so the driver, which only compiles and sends the automaton, never holds it.
        """
        bits, row = [column.tobytes() for column in self.allowed], self.row.tolist()
        self.start = row[-1]
        for number, text in enumerate(self.labels[:len(self.column)]):
            arc = (number, bits[self.column[number]], row[number]) if text else None
            if text and self.suffix and text.endswith(self.suffix):
                self.final[text.removesuffix(self.suffix)] = arc
            elif text:
                self.inner[text] = arc
        if not self.suffix:
            self.final = self.inner

    def __getstate__(self):
        return {**self.__dict__, "inner": {}, "final": {}}

    def encode(self, word: str) -> list[int]:
        """Labels of the only accepted path that spells the word.

        Exactly one label that ends at a place may be read in the state its begin leads to, so one pass finds the path.
        """
        if not self.inner:
            self._index()
        size, longest, table = len(word), self.longest, self.inner.get
        state, path = [self.start] + [-1] * size, [(0, -1)] * (size + 1)
        for end in range(1, size + 1):
            if end == size:
                table = self.final.get
            for begin in range(end - 1, max(-1, end - 1 - longest), -1):
                arc = table(word[begin:end])
                if arc is not None:
                    at = state[begin]
                    if at >= 0 and arc[1][at >> 3] >> (at & 7) & 1:
                        path[end], state[end] = (begin, arc[0]), arc[2]
                        break
        out, end = [], size
        while end:
            end, label = path[end]
            if label < 0:
                raise ValueError(f"the automaton has no path for {word!r}")
            out.append(label)
        return out[::-1]

    def decode(self, numbers: list[int]) -> list[str]:
        """The labels of the arcs."""
        return [self.labels[n] for n in numbers]


def load(text: str) -> dict:
    """The parts of a tokenizer file that the automaton and the splitting of texts need."""
    parts = json.loads(text)
    model = parts["model"]
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    return {"vocab": model["vocab"], "merges": merges, "suffix": model.get("end_of_word_suffix") or "",
            "added": {t["content"]: t["id"] for t in parts["added_tokens"]}}

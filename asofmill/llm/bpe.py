"""Byte-pair encoding and decoding of whole texts with a compiled automaton (``bpe_automaton``).

Texts are split as the tokenizer file says: strings of added tokens first, then NFC, lower case and the word pattern. Texts of
Latin characters are split here; for all others the splitting parts of the tokenizers library do it, as their Unicode version
decides which characters are letters. Each word runs through the automaton; decoding emits the labels of the arcs, joined by a
blank (the file names no decoder).

Defined results: a null or empty text has no tokens and decodes to the empty text; repeated rows give equal results; extra
columns are ignored; an empty table gives an empty result. Special tokens in a text are recognised as such.

Plan: no shuffle. The automaton is compiled once on the driver and broadcast; its size depends on the vocabulary only (some
25 MB for 49,000 tokens). A Python process keeps one automaton per tokenizer, whichever broadcast it came by, and caches words
in two tables of at most ``CACHE`` entries; long texts are digested piece by piece and batches are read row by row.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import give_back
from .bpe_automaton import Automaton, byte_symbols, load
from .rows import text_or_empty

CACHE = 120_000
PIECE = 20_000

#: The word pattern of the file. Fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters below U+0250 are in composed form and mean the same in every Unicode version; the separators that only some
#: libraries count as white space are left out.
PLAIN = regex.compile(r"[^\x1c-\x1fɐ-\U0010ffff]*+")


#: Codecs of this process by the digest of their file.
_LOADED: dict[str, Codec] = {}


def _loaded(key: str, state: dict) -> Codec:
    """The codec of this process; what came with the broadcast is only used the first time."""
    if key not in _LOADED:
        codec = Codec.__new__(Codec)
        codec.__dict__.update(state)
        codec._ready()
        _LOADED.clear()
        _LOADED[key] = codec
    return _LOADED[key]


def codec_of(tokenizer_json: str) -> Codec:
    """The codec of a tokenizer file, compiled once per process."""
    key = hashlib.sha256(tokenizer_json.encode()).hexdigest()
    if key not in _LOADED:
        codec = Codec(tokenizer_json)
        _LOADED.clear()
        _LOADED[key] = codec
    return _LOADED[key]


class Codec:
    """Encodes and decodes texts; made on the driver, sent to the tasks by broadcast."""

    def __init__(self, tokenizer_json: str):
        self.key = hashlib.sha256(tokenizer_json.encode()).hexdigest()
        parts = load(tokenizer_json)
        shell = json.loads(tokenizer_json)
        shell["model"] = {"type": "BPE", "vocab": {}, "merges": []}
        splits = [p["pattern"].get("Regex") for p in shell["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        if splits != [PATTERN]:
            raise ValueError(f"unknown word pattern {splits}")
        shell["added_tokens"] = []
        self.shell, self.added = json.dumps(shell), parts["added"]
        self.automaton = Automaton.compile(parts["vocab"], parts["merges"], parts["suffix"])
        for text, number in self.added.items():
            self.automaton.labels += [""] * (number + 1 - len(self.automaton.labels))
            self.automaton.labels[number] = text
        self._ready()

    def _ready(self) -> None:
        self.bytes_to_symbols, self.words = dict(enumerate(byte_symbols())), regex.compile(PATTERN)
        self.cuts = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.cache: dict[str, tuple[int, str, str]] = {}
        self.older: dict[str, tuple[int, str, str]] = {}  # the table that was full before; words still in use move back
        self.splitter = None

    def __reduce__(self):
        return _loaded, (self.key, {"key": self.key, "shell": self.shell, "added": self.added, "automaton": self.automaton})

    def _library_words(self, text: str) -> list[str]:
        """Words in byte symbols, split by the library."""
        if self.splitter is None:
            from tokenizers import Tokenizer

            self.splitter = Tokenizer.from_str(self.shell)
        return [w for w, _ in self.splitter.pre_tokenizer.pre_tokenize_str(self.splitter.normalizer.normalize_str(text))]

    def _entry(self, numbers: list[int]) -> tuple[int, str, str]:
        return len(numbers), " ".join(map(str, numbers)), self.decode(numbers)

    def _word(self, word: str) -> tuple[int, str, str]:
        """The entry of a word; one that starts with a blank is in byte symbols already."""
        found = self.older.get(word)
        if found is None:
            if word[0] == " ":
                symbols = word[1:]
            elif word.isascii() and word.isprintable():
                symbols = word
            else:
                symbols = word.encode().decode("latin-1").translate(self.bytes_to_symbols)
            found = self._entry(self.automaton.encode(symbols))
        if len(word) <= 64:
            if len(self.cache) >= CACHE:
                self.older = dict(self.cache)
                self.cache.clear()  # in place: ``entries`` holds on to its method
            self.cache[word] = found
        return found

    def entries(self, text: str) -> Iterator[tuple[int, str, str]]:
        """(number of labels, labels as text, decoded text) of successive words."""
        get, make = self.cache.get, self._word
        for part in self.cuts.split(text) if self.cuts and "<|" in text else (text,):
            if part in self.added:
                yield self._entry([self.added[part]])
                continue
            if PLAIN.fullmatch(part):
                words = self.words.findall(part.lower())
            else:
                words = [" " + w for w in self._library_words(part)] if part else ()
            for word in words:
                yield get(word) or make(word)

    def encode(self, text: str | None) -> list[int]:
        return [int(n) for _, numbers, _ in self.entries(text or "") for n in numbers.split(" ")]

    def decode(self, numbers: list[int]) -> str:
        return " ".join(self.automaton.decode(numbers))

    def digests(self, text: str | None) -> tuple[int, str, str]:
        """Number of tokens, digest of the decimal labels joined by a blank, digest of the decoded text."""
        count, ids, words, stream, lead = 0, hashlib.sha256(), hashlib.sha256(), self.entries(text or ""), ""
        while piece := list(islice(stream, PIECE)):
            numbers, labels, decoded = zip(*piece)
            count += sum(numbers)
            ids.update((lead + " ".join(labels)).encode())
            words.update((lead + " ".join(decoded)).encode())
            lead = " "
        return count, ids.hexdigest(), words.hexdigest()


def read_codec(docs: DataFrame, path: str):
    """The codec of a tokenizer file, as a broadcast variable."""
    with open(path, encoding="utf-8") as file:
        codec = docs.sparkSession.sparkContext.broadcast(codec_of(file.read()))
    give_back()
    return codec


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """All columns and the labels of the text as ``ids_col``."""
    codec = read_codec(docs, path)

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([codec.value.encode(t) for t in texts], dtype=object)

    return docs.withColumn(ids_col, run(text_or_empty(text_col)))


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """All columns and the decoded text as ``text_col``; null labels decode to the empty text."""
    codec = read_codec(encoded, path)

    @F.pandas_udf("string")
    def run(ids: pd.Series) -> pd.Series:
        return pd.Series([codec.value.decode([] if n is None else list(n)) for n in ids], dtype=object)

    return encoded.withColumn(text_col, run(F.col(ids_col)))


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    codec = read_codec(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec.value
        for batch in batches:
            found = [own.digests(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.string()),
                 pa.array([f[2] for f in found], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

"""The pipeline against the operators' plain versions, and its place beside the library."""

import hashlib
import pathlib
import re

import corpus_pipeline
from asofmill.llm import queries

from .test_near_copies import plain_kept
from .test_operators import FOLDER, SPACES, documents

ROOT = pathlib.Path(__file__).resolve().parents[2]


def body(text):
    return "".join(c for c in text or "" if c not in SPACES)


def test_stages_one_by_one(spark, tmp_path):
    docs = start = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(f"{tmp_path}/{name}")
        docs = kept[name] = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "bpe":
            assert docs.columns == start.columns
    texts = {i: t for i, t, _ in documents(FOLDER)}
    ids = {n: [r.doc_id for r in df.select("doc_id").collect()] for n, df in kept.items()}
    assert len(ids["toxicity"]) >= 0.8 * len(texts)
    groups = {}
    for i in sorted(ids["toxicity"], key=lambda i: (-len(texts[i]), i)):
        groups.setdefault(body(texts[i]), i)
    assert sorted(ids["exact_dedup"]) == sorted(groups.values())
    order = sorted(ids["exact_dedup"])
    # Five words a shingle, similarity 0.8 or more, whole components.
    assert sorted(ids["simhash_dedup"]) == [order[n] for n in plain_kept([texts[i] for i in order])]
    assert set(ids["mix"]) <= set(ids["simhash_dedup"]) and max(map(ids["mix"].count, ids["mix"])) <= 2
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_path())
    rows = kept["bpe"].collect()
    assert sorted(r.doc_id for r in rows) == sorted(ids["mix"])
    for r in rows[:50]:
        tokens = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(tokens), hashlib.sha256(" ".join(map(str, tokens)).encode()).hexdigest())


def test_stages_take_empty_and_hard_tables(spark, edge, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0
    assert corpus_pipeline.run(spark, edge).count() > 0


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "asofmill").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"\bllm\b", path.read_text()), path

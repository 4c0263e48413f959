"""The near-copy stage of the pipeline against similarities of all pairs."""

import random

import corpus_pipeline
from asofmill.llm import near_copies

from .test_operators import documents, union_find

FOLDER = "/root/testdata/sf0.01"


def plain_shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_kept(given):
    """Positions that stay when ids ascend."""
    sets = [plain_shingles(t) for t in given]
    holders = {}
    for n, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(n)
    near = [(n, m) for n, m in {(n, m) for at in holders.values() for n in at for m in at if m < n}
            if 5 * len(sets[n] & sets[m]) >= 4 * len(sets[n] | sets[m])]
    near += [(n, m) for n, s in enumerate(sets) for m in range(n) if not s and not sets[m]]
    root = union_find(len(given), near)
    return [n for n in range(len(given)) if root[n] == n]


def edited(words, edits, rng):
    words = list(words)
    for at in rng.sample(range(len(words)), edits):
        words[at] = f"edit{rng.random()}"
    return " ".join(words)


def test_edited_copies_go(spark):
    """Chains and hubs of edited texts on both sides of the bound, of 5 to 600 words."""
    rng = random.Random(6)
    given = [None, "", " \n", "one", "ONE", "one two three four", "one two three five"]
    for n in range(150):
        words = [f"w{rng.randrange(50_000)}" for _ in range(rng.choice([5, 12, 60, 200, 600]))]
        given.append(" ".join(words))
        for _ in range(3):
            given.append(edited(words, min(len(words), rng.randrange(0, 2 + len(words) // 30)), rng))
        words = edited(words, len(words) // 60, rng).split()
        given.append(edited(words, len(words) // 60, rng))
    hub = [f"h{n}" for n in range(300)]
    given += [edited(hub, rng.randrange(8), rng) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")
    expected = plain_kept(given)
    assert len(expected) < 0.6 * len(given)
    assert sorted(r.doc_id for r in corpus_pipeline.simhash_dedup(spark, docs, "").collect()) == expected


def test_driver_documents(spark):
    given = sorted(documents(FOLDER))[:500]
    docs = spark.createDataFrame([(n, t) for n, (_, t, _) in enumerate(given)], "doc_id long, text string")
    assert sorted(r.doc_id for r in near_copies.drop_similar(docs).collect()) == plain_kept([t for _, t, _ in given])


def test_repeated_rows_and_rows_without_id(spark):
    docs = spark.createDataFrame([(None, "a b"), (2, "a b"), (2, "A b"), (2, "a b"), (None, "c"), (None, "c")], "doc_id long, text string")
    kept = near_copies.drop_similar(docs)
    assert sorted((r.doc_id is None, r.doc_id, r.text.lower()) for r in kept.collect()) == [(False, 2, "a b"), (True, None, "c")]


def test_fingerprints_bring_texts_together(spark, monkeypatch):
    """Without any band key, SimHash and its trees alone connect copies whose fingerprints are near, and links are still exact."""
    rng = random.Random(9)
    given = []
    for _ in range(40):
        words = [f"w{rng.randrange(50_000)}" for _ in range(800)]
        given += [" ".join(words), edited(words, 1, rng), edited(words, 400, rng)]
    prints = [near_copies.fingerprint(near_copies.shingles(t)) for t in given]
    near = [(n, m) for n in range(len(given)) for m in range(n) if ((prints[n] ^ prints[m]) & (2 ** 64 - 1)).bit_count() <= 4]
    root = union_find(len(given), near)
    expected = [n for n in range(len(given)) if root[n] == n]
    assert 80 <= len(expected) < 100
    docs = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")
    monkeypatch.setattr(near_copies, "band_keys", lambda hashes: [])
    assert sorted(r.doc_id for r in near_copies.drop_similar(docs).collect()) == expected


def test_fingerprint_is_the_majority_of_distinct_shingles():
    text = "a b c d e f g a b c d e"
    hashes = [int(h) for h in near_copies.shingles(text)]
    bits = sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))
    assert near_copies.fingerprint(near_copies.shingles(text)) & (2 ** 64 - 1) == bits
    assert near_copies.fingerprint(near_copies.shingles(" ")) == 0

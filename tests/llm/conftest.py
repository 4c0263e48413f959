"""Small tables with every hard case: nulls, empty and long texts, ties, repeated rows, clashing column names, empty tables."""

import pytest
from pyspark.sql import functions as F

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "long words repeat here " * 4000


def edge_documents():
    texts = [
        (1, "alpha beta gamma delta epsilon"), (2, "alpha beta  gamma delta\tepsilon"), (3, "ALPHA beta gamma delta epsilon"), (4, None), (5, ""),
        (6, " \t\n"), (7, LONG), (8, LONG), (9, "one"), (9, "one"), (10, "two words"), (11, "x\x0by\x0cz"), (12, "xyz"), (None, "no id here"),
        (None, "no id here"), (13, "Σας ΣΑΣ <|endoftext|> İstanbul é ｆｕｌｌ 漢字"), (14, "Released under the MIT Licence.\nnothing\nLICENSED!! under%%% cc-by-nc 4.0"),
        (15, 'token = "4d44c79e8bf7c55759c4958dd60ed83d2ef8cd4e" and 4699065906345690'), (16, "\ufffe\x00 odd \u200b characters \x85 here"), (17, "aab"), (17, "ba a"),
    ]
    sources = ["s1", None, "s2", "", "S1"]
    return [(i, t, "en", sources[n % 5], None if t is None else len(t)) for n, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def edge(spark, tmp_path_factory):
    """A folder of tables in the driver's layout."""
    folder = str(tmp_path_factory.mktemp("edge"))
    documents = spark.createDataFrame(edge_documents(), DOC)
    clash = documents.withColumns({c: F.lit("clash") for c in ("id", "x", "kept", "size", "h", "score", "fp", "root", "hash", "whole", "KEY", "_x")})
    clash.write.parquet(f"{folder}/documents.parquet")
    labels = [(1, 1, 0), (2, None, 1), (None, 1, 1), (4, 1, 0), (7, 0, None), (7, 1, 1), (10, 1, 0), (12, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    urls = ["http://A.example.NET/en/1?x#y", "https://example.net/EN/1", "https://example.net/en", "ftp://x.org/fr/", "http://org/fr/q", None, "", "no scheme/net/",
            "http://net", "http://net/", "http://m.example.com/de/a?b", "http://notexample.com/de/a", "http://x.net?/en/", "a://b://c.net/", "http://x.net/",
            "http://x.net/", "http://" + "a." * 3000 + "net/" + "p/" * 3000, "HTTP://user@EXAMPLE.net:80/en/", "x\n://y.net/\nz"]
    spark.createDataFrame([(n, u, "html") for n, u in enumerate(urls)] + [(None, "http://q.net/", None)], "page_id long, url string, html string").write.parquet(
        f"{folder}/pages.parquet")
    nan, inf = float("nan"), float("inf")
    vectors = [(1, [1.0, 0.0, 0.0]), (2, [0.9, 0.435889894354, 0.0]), (3, [0.0, 1.0, 0.0]), (4, None), (5, []), (6, [0.0, 0.0, 0.0]), (7, [nan, 1.0, 0.0]),
               (8, [inf, 1.0, 0.0]), (9, [None, 1.0, 0.0]), (10, [1.0, 0.0, 0.0]), (10, [1.0, 0.0, 0.0]), (11, [1.0, 0.0]), (12, [2e30, 1e29, 0.0]), (None, [0.0, 0.99, 0.01]),
               (13, [-1.0, 0.0, 0.0])]
    spark.createDataFrame([(i, v, 0) for i, v in vectors], "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    items = [(1, "Alpha BETA beta one"), (2, None), (3, ""), (4, "x漢字 漢字 Σας repeat words"), (1, "xyz alpha x y z"), (None, "two words id here"), (5, "nowhere to be found")]
    spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit("clash") for c in ("terms", "row", "doc_id", "rank", "n")}).write.parquet(f"{folder}/benchmark.parquet")
    turns = [(0, 0, "user", "hi"), (0, 1, "assistant", "hello"), (0, None, None, None), (0, 2, "user", "é" * 50), (1, 0, "user", "own"), (1, 1, "user", "own"), (2, 5, "user", "hi"),
             (2, 5, "bot", "tie"), (2, 5, "bot", "a tie"), (2, 5, "bot", "a tie"), (3, 1, "", ""), (4, 0, "user", "hi"), (9, 0, "user", "base is missing"), (9, 1, "user", "x"), (11, 0, "a", "b"),
             (11, 1, "a", "bc"), (12, 0, "ab", ""), (None, 0, "user", "belongs to none"), (-3, 0, "user", "below zero"), (7, 0, "x", LONG), (8, 0, "x", LONG), (8, 3, "x", "y")]
    turns += [(c, t, "user", f"turn {t}") for c in (20, 21, 22, 30) for t in range(12 + c % 3)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumns(
        {c: F.lit("clash") for c in ("c", "d", "pos", "k1", "bytes", "h", "tie")}).write.parquet(f"{folder}/conversations.parquet")
    return folder


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory, edge):
    """The same tables without rows."""
    folder = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "labels", "pages", "embeddings", "benchmark", "conversations"):
        spark.read.parquet(f"{edge}/{name}.parquet").limit(0).write.parquet(f"{folder}/{name}.parquet")
    return folder

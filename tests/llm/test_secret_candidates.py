"""Secrets that are short, without a digit or with punctuation."""

from asofmill.llm import secret_scan


def test_values_of_secret_names(spark):
    given = {
        'password = "Sommer2024!"': "Sommer2024!", "secret: correcthorsebatterystaple": "correcthorsebatterystaple",
        "pwd=p@ss-w0rd!Long#1": "p@ss-w0rd!Long#1", '{"api_key":"a,b;c"}': "a,b;c", "x PASSWORD='correct horse  staple' y": "correct horse staple",
        "auth_token := 'q'": "q", "password ='zz';": "zz", 'secret = "never closed': "never", "bare ThisRunHasNoDigitAtAll here": "ThisRunHasNoDigitAtAll",
    }
    docs = spark.createDataFrame([(n, t, "src") for n, t in enumerate(given)] + [(99, "the secret of a key: =", "src")], "doc_id long, text string, source string")
    found = [(r.doc_id, r.candidate) for r in secret_scan.candidates(docs).collect()]
    assert {(n, v) for n, v in enumerate(given.values())} <= set(found) and 99 not in dict(found)
    assert len(found) == len(set(found))


def test_forest_judges_short_secrets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "source")
    more = spark.createDataFrame([(-1, 'password = "Sommer2024!"', "web")], "doc_id long, text string, source string")
    judged = [r.secret for r in secret_scan.secret_scan(docs.unionByName(more)).where("doc_id = -1").collect()]
    assert judged == [True]


def test_training_sample_has_no_copies(spark, monkeypatch):
    kept = {}
    monkeypatch.setattr(secret_scan, "staged", lambda df, label: kept.setdefault(label, df))
    texts = ['token = "x9K2mLq8Zt4Rv7Wy1B"'] * 30 + [f'token = "x9K2mLq8Zt4Rv7Wy{"q" * n}"' for n in range(1, 8)] + [f"sha {n}4699065906345690" for n in range(1, 8)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("source", secret_scan.F.lit("src"))
    secret_scan.secret_scan(docs, training=10)
    sample = [tuple(r) for r in kept["secret-training"].where("label = 1").collect()]
    assert len(sample) == 5 and len(set(sample)) == 5

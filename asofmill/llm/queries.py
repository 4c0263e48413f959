"""The registered queries of this subpackage and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import pin
from .bpe import encode_digests
from .embedding_dedup import embedding_links
from .exact_dedup import exact_dedup
from .lexical_search import lexical_top
from .license_scan import license_scan
from .license_texts import KNOWN
from .mixing import mix
from .prefix_trie import conversation_trie
from .secret_scan import secret_scan
from .sharding import sharded
from .simhash import simhash_components
from .toxicity import toxicity_scores
from .url_filter import filtered
from .vector_search import nearest_neighbours

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(pin(spark), sf_dir)
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query()
def op1_simhash_components(spark, sf_dir):
    return simhash_components(_table(spark, sf_dir, "documents"))


@_query()
def op2_toxicity(spark, sf_dir):
    return toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query(r"""
WITH RECURSIVE sized AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
        md5(coalesce(doc_id::varchar, '') || '/17') AS hash
    FROM documents
), numbered AS (
    SELECT source, sum(size)::bigint AS source_size,
        [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1]::double AS weight
    FROM sized GROUP BY source
), filled(clamped, rest, weights, before) AS (
    SELECT 0::bigint, 1.5::double * sum(source_size)::double, sum(weight)::double, -1::bigint FROM numbered
    UNION ALL
    SELECT
        (SELECT count(*) FROM numbered n WHERE f.rest * n.weight / f.weights > n.source_size * 2),
        (SELECT 1.5::double * sum(source_size)::double - coalesce(sum(source_size * 2) FILTER (f.rest * weight / f.weights > source_size * 2), 0)::double FROM numbered),
        (SELECT sum(weight) - coalesce(sum(weight) FILTER (f.rest * weight / f.weights > source_size * 2), 0) FROM numbered),
        f.clamped
    FROM filled f WHERE f.clamped <> f.before AND f.weights > 0
), level AS (
    SELECT rest, weights FROM filled WHERE clamped = before OR weights <= 0
), targets AS (
    SELECT n.source, n.source_size,
        CASE WHEN l.weights <= 0 OR l.rest * n.weight / l.weights > n.source_size * 2 THEN (n.source_size * 2)::double
            ELSE l.rest * n.weight / l.weights END AS target
    FROM numbered n, level l
), goals AS (
    SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole,
        target - CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END * source_size AS missing
    FROM targets
), drawn AS (
    SELECT s.*, g.source_size, g.target, g.whole, g.missing,
        sum(s.size) OVER (PARTITION BY s.source ORDER BY s.hash ROWS UNBOUNDED PRECEDING) AS running
    FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
    (size * (whole + (missing > 0 AND running - size / 2.0 <= missing)::bigint))::bigint AS taken
FROM drawn
""")
def op5_mix_sources(spark, sf_dir):
    return mix(_table(spark, sf_dir, "documents"))


@_query()
def op3_secret_scan(spark, sf_dir):
    return secret_scan(_table(spark, sf_dir, "documents"))


def _license_values() -> str:
    return ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in KNOWN)


@_query(r"""
WITH known(license, text) AS (VALUES """ + _license_values() + r"""
), bodies AS (
    SELECT 'k' AS kind, row_number() OVER () AS id, license, text FROM known
    UNION ALL SELECT 'd', doc_id, NULL, coalesce(text, '') FROM documents
), clean AS (
    SELECT kind, id, license, string_split(regexp_replace(replace(replace(replace(replace(replace(replace(replace(
        regexp_replace(lower(text), '(?m)^[^\p{L}\p{N}\n]*(?:copyright|\(c\)|©|all rights reserved)(?:[^\p{L}\p{N}\n][^\n]*)?$', '', 'g'),
        'licence', 'license'), 'sub-license', 'sublicense'), 'non-infringement', 'noninfringement'), 'organisation', 'organization'),
        'authorisation', 'authorization'), 'https://', 'http://'), 'and/or', 'and or'), '[^\p{L}\p{N}\n]+', ' ', 'g'), chr(10)) AS parts
    FROM bodies
), units AS (
    SELECT kind, id, license, 0 AS line, array_to_string(list_filter(list_transform(parts, lambda p: trim(p)), lambda p: p <> ''), ' ') AS body FROM clean
    UNION ALL SELECT kind, id, license, unnest(range(1, len(parts) + 1))::int, trim(unnest(parts)) FROM clean WHERE kind = 'd'
), digests AS (
    SELECT sha256(body) AS digest, min(license) AS license FROM units WHERE kind = 'k' GROUP BY body
)
SELECT u.id AS doc_id, CASE WHEN u.line = 0 THEN 'text' ELSE 'line' END AS unit, u.line, d.license, d.digest
FROM units u JOIN digests d ON sha256(u.body) = d.digest WHERE u.kind = 'd' AND u.body <> ''
""".replace("\\\\", "\\"))
def op4_license_scan(spark, sf_dir):
    return license_scan(_table(spark, sf_dir, "documents"))


#: The rules of the query. Fixed values.
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


@_query(r"""
WITH split AS (
    SELECT page_id, translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
    FROM pages
), rules(rule, rule_host, rule_path, verdict) AS (
    VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
        ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')
), pages_of AS (SELECT *, row_number() OVER () AS n FROM split
), fits AS (
    SELECT p.n, r.rule, r.verdict, row_number() OVER (PARTITION BY p.n ORDER BY length(r.rule) DESC) AS place
    FROM pages_of p JOIN rules r ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path)
)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM pages_of p LEFT JOIN fits f ON p.n = f.n AND f.place = 1
""")
def op6_url_filter(spark, sf_dir):
    rules = spark.createDataFrame(URL_RULES, "rule string, verdict string")
    return filtered(_table(spark, sf_dir, "pages"), rules)


@_query(r"""
WITH normal AS (
    SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
    FROM documents
), ranked AS (
    SELECT doc_id, sha256(body) AS text_sha256,
        first_value(doc_id) OVER (PARTITION BY body ORDER BY chars DESC, doc_id) AS keep_id,
        count(*) OVER (PARTITION BY body) AS group_size
    FROM normal
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM ranked
""")
def op8_exact_dedup(spark, sf_dir):
    return exact_dedup(_table(spark, sf_dir, "documents"))


@_query()
def op7_embedding_links(spark, sf_dir):
    return embedding_links(_table(spark, sf_dir, "embeddings"))


@_query()
def op9_rendezvous_shards(spark, sf_dir):
    return sharded(_table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    """Where the public tokenizer lies; the file is read, never copied."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@_query()
def op10_bpe_encode_decode(spark, sf_dir):
    return encode_digests(_table(spark, sf_dir, "documents"), tokenizer_path())


#: Upper and lower case of the letters that terms fold. Fixed values.
_FOLD = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


@_query(r"""
WITH held AS (
    SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(translate(text, """ + _FOLD + r"""), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents WHERE text IS NOT NULL
), sized AS (SELECT d, doc_id, len(terms) AS n FROM held WHERE len(terms) > 0
), corpus AS (SELECT count(*) AS docs, sum(n)::bigint AS size FROM sized
), occurring AS (SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(terms) AS term FROM held) GROUP BY d, term
), weights AS (
    SELECT term, floor(1000 * ln((2 * (SELECT docs FROM corpus) + 2)::double / (2 * count(*) + 1)))::bigint AS w FROM occurring GROUP BY term
), items AS (SELECT row_number() OVER () AS i, item_id, text FROM benchmark
), asked AS (
    SELECT i, item_id, term, count(*) AS times
    FROM (SELECT i, item_id, unnest(regexp_extract_all(translate(text, """ + _FOLD + r"""), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM items)
    GROUP BY i, item_id, term
), scored AS (
    SELECT a.i, a.item_id, s.doc_id,
        sum(a.times * w.w * ((1000000000 * o.tf) // (1000 * o.tf + 12 * (75 + (25 * s.n * c.docs) // c.size))))::bigint AS score
    FROM asked a JOIN weights w USING (term) JOIN occurring o USING (term) JOIN sized s ON s.d = o.d, corpus c
    GROUP BY a.i, a.item_id, o.d, s.doc_id
), ranked AS (
    SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT item_id, rank::int AS rank, doc_id, score FROM ranked WHERE rank <= 20
""")
def op11_lexical_search(spark, sf_dir):
    return lexical_top(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query("""
WITH vectors AS (
    SELECT row_number() OVER () AS n, vec_id, embedding::double[] AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), scored AS (
    SELECT q.n, q.vec_id AS query_id, c.vec_id,
        list_dot_product(q.v, c.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(c.v, c.v))) AS score
    FROM vectors q JOIN vectors c ON q.n <> c.n AND len(q.v) = len(c.v)
    WHERE q.vec_id % 50 = 0
), ranked AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM scored)
SELECT query_id, rank::int AS rank, vec_id, score FROM ranked WHERE rank <= 5
""")
def op12_nearest_neighbours(spark, sf_dir):
    return nearest_neighbours(_table(spark, sf_dir, "embeddings"))


@_query("""
WITH ordered AS (
    SELECT conv_id AS c, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), steps AS (  -- CRC-32: a byte, then eight shifts
    SELECT c, turns, list_prepend(4294967295, flatten(list_transform(string_split(c::varchar, ''), lambda s: list_concat([ascii(s)::bigint], [-1, -1, -1, -1, -1, -1, -1, -1])))) AS todo
    FROM ordered
), hashed AS (
    SELECT c, turns, xor(list_reduce(todo, lambda v, s: CASE WHEN s >= 0 THEN xor(v, s) WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END), 4294967295) % 9 AS h
    FROM steps
), rebuilt AS (
    SELECT a.c, list_concat(coalesce(b.turns[1:a.h], []), a.turns[a.h + 1:]) AS turns
    FROM hashed a LEFT JOIN ordered b ON b.c = a.c - a.c % 5
), paths AS (
    SELECT c, turns, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt
), nodes AS (
    SELECT d, turns[1:d] AS path, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(c::varchar, ',' ORDER BY c) FILTER (d = len(turns)), '')) AS ends_sha256
    FROM paths GROUP BY d, turns[1:d]
), linked AS (
    SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes k WHERE k.d = n.d + 1 AND k.path[1:n.d] = n.path) AS n_children
    FROM nodes n LEFT JOIN nodes p ON p.d = n.d - 1 AND p.path = n.path[1:n.d - 1]
), rolled AS (
    SELECT v.d, v.path, sum((u.n_children = 0)::int)::bigint AS n_leaves,
        sum(CASE WHEN u.d = 0 THEN 0 ELSE (u.n_convs - 1) * strlen(u.path[u.d].t) END)::bigint AS saved_tokens
    FROM linked v JOIN linked u ON u.d >= v.d AND u.path[1:v.d] = v.path GROUP BY v.d, v.path
)
SELECT l.conv_id, l.d AS depth, l.parent_conv_id, l.n_convs, l.n_children, r.n_leaves, r.saved_tokens, l.ends_sha256
FROM linked l JOIN rolled r ON r.d = l.d AND r.path = l.path
""")
def op13_conversation_trie(spark, sf_dir):
    return conversation_trie(_table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)

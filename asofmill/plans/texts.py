"""Documents, quotations, assessments, redaction and dataset versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.clocks import offset_instant, utc_text
from ..functions.identity import sha256
from ..functions.rules import violations
from ..functions.text import MASK, redact_columns
from ..operators import documents as D
from ..operators import versions as V
from ..sources import adapters as A
from ..sources.tables import driver_table, spread
from .registry import query

c = F.col

DOCS = """docs AS (SELECT doc_id, text, sha256(text) AS hash, n_chars, TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 28 AS INTEGER)) AS published,
  CASE WHEN doc_id % 50 = 0 THEN -1 ELSE doc_id % 5 END AS hours FROM documents)"""
EVIDENCE = f"""{DOCS}, cited AS (SELECT l.doc_id AS cited_by,
    CASE WHEN l.doc_id % 40 = 0 THEN l.doc_id + 1000000000000 ELSE l.doc_id END AS document_id,
    CASE WHEN quality = 0 AND l.doc_id % 3 = 0 THEN 'bad' ELSE hash END AS hash, n_chars // 3 AS s, n_chars - n_chars // 4 AS e,
    toxic, text FROM labels l JOIN docs d ON d.doc_id = l.doc_id),
quotes AS (SELECT *, CASE WHEN toxic = 1 THEN piece || 'x' WHEN cited_by % 6 = 1 THEN '#' || substring(piece, 2) ELSE piece END AS quote
  FROM (SELECT *, substring(text, s + 1, e - s) AS piece FROM cited))"""


@query(f"""WITH {EVIDENCE}
SELECT cited_by, q.document_id, CASE WHEN length(quote) <> e - s THEN 'span_length' WHEN d.doc_id IS NULL THEN 'missing_document'
  WHEN d.hash <> q.hash THEN 'content_hash' WHEN quote <> piece THEN 'span_text' ELSE 'ok' END AS verdict
FROM quotes q LEFT JOIN docs d ON d.doc_id = q.document_id""")
def evidence_spans(spark, sf):
    verdicts = D.verify_quotes(A.evidence(spark, sf), A.documents(spark, sf))
    return verdicts.select("cited_by", "document_id", "verdict")


@query(f"""WITH {EVIDENCE}
SELECT cited_by, document_id FROM quotes WHERE document_id NOT IN (SELECT doc_id FROM documents)""")
def missing_documents(spark, sf):
    return D.missing_documents(A.evidence(spark, sf).select("cited_by", "document_id"), A.documents(spark, sf))


@query(f"""WITH {DOCS}
SELECT l.doc_id AS document_id FROM labels l JOIN docs d USING (doc_id)
WHERE d.published + to_hours(CAST(hours AS INTEGER)) > TIMESTAMP '2024-01-14 02:00:00'""")
def late_documents(spark, sf):
    references = driver_table(spark, sf, "labels").select(
        c("doc_id").alias("document_id"), F.lit("2024-01-14 02:00:00").cast("timestamp").alias("source_cutoff")
    )
    return D.late_documents(references, A.documents(spark, sf)).select("document_id")


@query("SELECT doc_id AS document_id, 'clock_order' AS reason FROM documents WHERE doc_id % 50 = 0 OR doc_id % 5 = 4")
def document_constraints(spark, sf):
    return violations(A.documents(spark, sf), ["document_id"], D.document_rules())


@query("""SELECT sha256(text) AS content_sha256, count(*) AS copies, min(doc_id) AS first_id, max(doc_id) AS last_id
FROM documents GROUP BY sha256(text) HAVING count(*) > 1""")
def duplicate_contents(spark, sf):
    return D.duplicate_contents(A.documents(spark, sf))


@query("""WITH a AS (SELECT c_custkey AS k, [k, k + 1] AS src, CASE WHEN k % 7 = 0 THEN [k + 1] ELSE [k + 2] END AS cmp,
  CASE k % 5 WHEN 0 THEN [k] WHEN 1 THEN [k, k + 2, k + 9] WHEN 2 THEN CAST([] AS BIGINT[]) ELSE [k + 1, k + 2] END AS cited FROM customer)
SELECT k AS assessment_id, unnest(list_filter([
  CASE WHEN k % 7 = 0 THEN 'duplicate_reference' END,
  CASE WHEN k % 11 = 0 OR k % 13 = 0 THEN 'clock_order' END,
  CASE WHEN k % 2 = 0 AND k % 13 = 0 THEN 'generated_after_expiry' END,
  CASE WHEN k % 17 = 0 THEN 'model_cutoff' END,
  CASE WHEN len(list_filter(cited, lambda x: NOT list_contains(list_concat(src, cmp), x))) > 0 THEN 'undeclared_citation' END,
  CASE WHEN k % 3 <> 0 AND NOT (list_has_any(cited, src) AND list_has_any(cited, cmp)) THEN 'one_sided_evidence' END
  ], lambda x: x IS NOT NULL)) AS reason FROM a""")
def assessment_checks(spark, sf):
    k = c("c_custkey")
    at = F.lit("2024-01-10").cast("timestamp")
    day = lambda n: at + F.expr(f"INTERVAL {n} DAYS")
    none = F.array().cast("array<bigint>")
    rows = driver_table(spark, sf, "customer").select(
        k.alias("assessment_id"), F.array(k, k + 1).alias("source_document_ids"),
        F.when(k % 7 == 0, F.array(k + 1)).otherwise(F.array(k + 2)).alias("comparison_document_ids"),
        F.when(k % 5 == 0, F.array(k)).when(k % 5 == 1, F.array(k, k + 2, k + 9)).when(k % 5 == 2, none)
        .otherwise(F.array(k + 1, k + 2)).alias("cited_ids"),
        F.when(k % 11 == 0, day(2)).otherwise(day(0)).alias("source_cutoff"), day(1).alias("generated_at"),
        F.when(k % 13 == 0, day(-1)).otherwise(day(5)).alias("expires_at"),
        F.when(k % 2 == 0, "prospective").otherwise("historical_exploratory").alias("use"),
        F.when(k % 17 == 0, day(3)).alias("training_cutoff"),
        F.when(k % 3 == 0, "unknown").otherwise("tighter").alias("policy_direction"), F.lit("unknown").alias("concern_change"),
    )
    return D.assessment_violations(rows)


# Stated here on its own: a header up to the end of its line or a quoted value, then named fields up to white space or a closing mark.
@query(r"""WITH headers AS (SELECT doc_id, regexp_replace(text,
    '(?im)(["\']?\bauthorization["\']?\s*[:=]\s*)(?:(?:"(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\])*\')|[^\r\n]+)', '\1[REDACTED]', 'g') AS text FROM documents),
r AS (SELECT doc_id, regexp_replace(text, '(?i)(["\']?\b(?:[a-z0-9_]*(?:api_?(?:key|secret)|token|password)|secret)["\']?\s*[:=]\s*)' ||
    '(?:(?:"(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\])*\')|\[REDACTED\]|[^\s,;}\]]+)', '\1[REDACTED]', 'g') AS redacted FROM headers)
SELECT doc_id, sha256(redacted) AS redacted_sha256, length(redacted) AS n_chars,
  CAST((length(redacted) - length(replace(redacted, '[REDACTED]', ''))) // 10 AS INTEGER) AS masks FROM r""".replace("\\'", "''"))
def redacted_text(spark, sf):
    docs = redact_columns(spread(driver_table(spark, sf, "documents").select("doc_id", "text")), ["text"])
    masks = F.regexp_count("text", F.lit(r"\[REDACTED\]"))
    return docs.select("doc_id", sha256(c("text")).alias("redacted_sha256"), F.length("text").alias("n_chars"), masks.alias("masks"))


PROPS = """lines AS (SELECT event_id, CASE event_id % 6
  WHEN 0 THEN 'login api_key=k' || CAST(user_id AS VARCHAR) || ' ok' WHEN 1 THEN 'Authorization: Bearer t' || CAST(user_id AS VARCHAR)
  WHEN 2 THEN '{"db_password": "p\\"' || CAST(user_id AS VARCHAR) || '", "k": 1}' WHEN 3 THEN 'harmless tokenizer ' || props
  WHEN 4 THEN 'known hunter' || CAST(user_id % 3 AS VARCHAR) || ' value' ELSE 'access_token : ' || CAST(user_id AS VARCHAR) || ', next' END AS line FROM events)"""


@query(f"""WITH {PROPS}
SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'login api_key={MASK} ok' WHEN 1 THEN 'Authorization: {MASK}'
  WHEN 2 THEN '{{"db_password": {MASK}, "k": 1}}' WHEN 3 THEN line
  WHEN 4 THEN CASE WHEN user_id % 3 = 2 THEN 'known {MASK} value' ELSE line END ELSE 'access_token : {MASK}, next' END AS line
FROM lines JOIN events USING (event_id)""")
def redacted_lines(spark, sf):
    user = c("user_id").cast("string")
    shape = c("event_id") % 6
    line = (
        F.when(shape == 0, F.concat(F.lit("login api_key=k"), user, F.lit(" ok")))
        .when(shape == 1, F.concat(F.lit("Authorization: Bearer t"), user))
        .when(shape == 2, F.concat(F.lit('{"db_password": "p\\"'), user, F.lit('", "k": 1}')))
        .when(shape == 3, F.concat(F.lit("harmless tokenizer "), c("props")))
        .when(shape == 4, F.concat(F.lit("known hunter"), (c("user_id") % 3).cast("string"), F.lit(" value")))
        .otherwise(F.concat(F.lit("access_token : "), user, F.lit(", next")))
    )
    events = driver_table(spark, sf, "events").select("event_id", line.alias("line"))
    return redact_columns(events, ["line"], ["hunter2"])


@query("""SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed'
  ELSE 'changed' END AS change
FROM (SELECT * FROM documents WHERE doc_id % 17 <> 0) o FULL JOIN
     (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN text || '!' ELSE text END AS text FROM documents WHERE doc_id % 19 <> 0) n
  ON o.doc_id = n.doc_id WHERE o.doc_id IS NULL OR n.doc_id IS NULL OR o.text <> n.text""")
def doc_changed_versions(spark, sf):
    docs = spread(driver_table(spark, sf, "documents").select("doc_id", "text", "lang", "source"))
    old = docs.where(c("doc_id") % 17 != 0)
    new = docs.where(c("doc_id") % 19 != 0).withColumn(
        "text", F.when(c("doc_id") % 10 == 0, F.concat("text", F.lit("!"))).otherwise(c("text"))
    )
    return V.version_diff(old, new, ["doc_id"])


@query("""SELECT event_id, CASE WHEN event_id % 4 IN (0, 3) THEN strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S.%fZ')
  WHEN event_id % 4 = 2 THEN strftime(date_trunc('second', ts) + INTERVAL 5 HOUR, '%Y-%m-%dT%H:%M:%S.%fZ') END AS instant FROM events""")
def timestamp_texts(spark, sf):
    at = F.date_format(c("ts"), "yyyy-MM-dd'T'HH:mm:ss")
    shape = c("event_id") % 4
    text = (
        F.when(shape == 0, F.concat(at, F.lit("Z"))).when(shape == 1, at)
        .when(shape == 2, F.concat(at, F.lit("-05:00"))).otherwise(F.concat(at, F.lit("+00:00")))
    )
    return driver_table(spark, sf, "events").select("event_id", utc_text(offset_instant(text)).alias("instant"))

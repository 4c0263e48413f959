"""Secret scan: candidates by shape, false positives removed by a random forest.

A candidate is a run of at least ``SHORTEST`` characters of keys and digests, or any value assigned to a secret-like name, of any
length and characters; in quotes it may hold blanks (up to ``PHRASE`` characters, else its first word). The forest sees its length,
transitions between kinds of characters, coverage by dictionary words, its neighbouring words and the path it was found under; it
is trained from labelled findings.

Where no labelled findings are given, candidates that a strict rule decides serve as such: a quoted value assigned to a name like
``token`` or ``secret`` is labelled 1; a bare number, one in a web address and one introduced as a digest, version or card number
is labelled 0. The rule's parts are features, but so are the others, and every candidate is judged by the forest alone.

Defined results: null and empty texts have no candidates; candidates of repeated rows are reported for each row; a null path has no
features; without labelled findings of both classes nothing is removed (score null, secret true); extra columns are ignored; an
empty table gives an empty result.

Plan (DataFrame functions and Spark's own forest): texts are split and searched in one pass without shuffle, and the candidates,
a small table, are written; training takes at most ``TRAINING`` distinct ones of them by hash, scoring all.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .rows import SPACE, text_or_empty

SHORTEST = 16
SHAPE = r"[A-Za-z0-9_+/=\-]{16,}"
PHRASE = 200
TRAINING = 20_000
TREES = 24
DEPTH = 6
THRESHOLD = 0.5

#: Words of names for secrets, of names for harmless values, of paths that hold examples, and common words. Fixed values.
SECRET_NAMES = "token|secret|password|passwd|pwd|apikey|api_key|api-key|key|auth|bearer|credential|private"
HARMLESS_NAMES = "sha|md5|checksum|digest|commit|hash|revision|uuid|version|build|card|phone|isbn|http|www"
EXAMPLE_PATHS = "test|example|sample|mock|fixture|doc|demo"
DICTIONARY = ("the and for with this that from have will your about which their there would could other after first only between under "
              "over into some time year people part place state world number group system program question work point company order "
              "service network server client user name file path data table value index config default public private example test "
              "version release build module package class function method return string object list array map set key token secret "
              "password http https www com org net html json xml image video audio content title page link home search").split()

_QUOTE = "[\"'`]"
#: A secret-like name with the rest of its word, and what stands between a name and its value.
_NAMED = rf"(?i)(?:{SECRET_NAMES})[\w.\-]*[\"'`\]]*"
_ASSIGN = "[:=]+>?"


def _value(before: Column, here: Column, rest: Column) -> Column:
    """The value in the word ``here`` assigned to a secret-like name in this word or in the two ``before``; else an empty string."""
    inside, ahead = rf"{_NAMED}{_ASSIGN}(.+)$", rf"^{_ASSIGN}(.+)$"
    raw = F.when(here.rlike(inside), F.regexp_extract(here, inside, 1)).when(
        before.rlike(rf"{_NAMED}$") & here.rlike(ahead), F.regexp_extract(here, ahead, 1)).when(
        before.rlike(rf"{_NAMED} ?{_ASSIGN}$") & ~here.rlike(rf"^{_ASSIGN}$"), here).otherwise("")
    quoted = F.regexp_extract(F.concat_ws(" ", raw, rest), rf"^({_QUOTE})(.{{1,{PHRASE}}}?)\1", 2)
    bare = F.regexp_replace(raw, rf"^{_QUOTE}|(?:{_QUOTE}|[;,])+$", "")
    return F.when(raw.rlike(f"^{_QUOTE}") & (quoted != ""), quoted).otherwise(bare)


def _share(part: Column, length: Column) -> Column:
    return part.cast("double") / length


def _matches(column: Column, pattern: str) -> Column:
    return F.coalesce(F.lower(column).rlike(pattern), F.lit(False)).cast("double")


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """(doc_id, path, word, before2, before, after, candidate, ordinal); word counts from 1."""
    words = F.split(text_or_empty(text_col), SPACE + "+")
    source = docs.where(F.col(text_col).rlike(SHAPE) | F.col(text_col).rlike(rf"{_NAMED}{SPACE}*[:=]")).select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(path_col).cast("string").alias("path"), words.alias("words"))

    def possible(n: Column) -> Column:
        here, before = F.get("words", n - 1), F.coalesce(F.get("words", n - 2), F.lit(""))
        return ((F.length(here) >= SHORTEST) & here.rlike(SHAPE)) | here.rlike("[:=].") | before.rlike(f"{_ASSIGN}$")

    hit = F.filter(F.sequence(F.lit(1), F.size("words")), possible)
    placed = source.select("*", F.explode(hit).alias("word")).select(
        "doc_id", "path", "word", F.get("words", F.col("word") - 3).alias("before2"), F.get("words", F.col("word") - 2).alias("before"),
        F.get("words", F.col("word") - 1).alias("here"), F.get("words", F.col("word")).alias("after"),
        # A word has a character at least, so these hold all of a quoted phrase.
        F.array_join(F.slice("words", F.col("word") + 1, PHRASE), " ").alias("rest"))
    runs = F.regexp_extract_all("here", F.lit(f"({SHAPE})"), 1)
    value = _value(F.concat_ws(" ", "before2", "before"), F.col("here"), F.col("rest"))
    both = placed.withColumn("runs", runs).withColumn("value", value)
    every = F.when((F.col("value") == "") | F.array_contains("runs", F.col("value")), F.col("runs")).otherwise(F.concat("runs", F.array("value")))
    return both.select("doc_id", "path", "word", "before2", "before", "here", "after", F.posexplode(every).alias("ordinal", "candidate"))


def features(found: DataFrame) -> tuple[DataFrame, list[str]]:
    """Candidates with feature columns, and the names of these."""
    c, low, length = F.col("candidate"), F.lower("candidate"), F.length("candidate").cast("double")
    quoted = F.col("here").rlike("[\"'`]").cast("double")
    covered = length - F.length(F.regexp_replace(low, "|".join(sorted(DICTIONARY, key=len, reverse=True)), ""))
    columns = {
        "f_length": F.log2(length),
        "f_letter_digit": _share(F.regexp_count(c, F.lit("[A-Za-z](?=[0-9])")), length),
        "f_digit_letter": _share(F.regexp_count(c, F.lit("[0-9](?=[A-Za-z])")), length),
        "f_case_change": _share(F.regexp_count(c, F.lit("[a-z](?=[A-Z])|[A-Z](?=[a-z])")), length),
        "f_vowel_consonant": _share(F.regexp_count(low, F.lit("[aeiou](?=[bcdfghjklmnpqrstvwxyz])")), length),
        "f_repeat": _share(F.regexp_count(low, F.lit(r"(.)(?=\1)")), length),
        "f_digits": _share(F.regexp_count(c, F.lit("[0-9]")), length),
        "f_symbols": _share(F.regexp_count(c, F.lit("[^A-Za-z0-9]")), length),
        "f_hex": c.rlike("^(?i)[0-9a-f]+$").cast("double"),
        "f_dictionary": _share(covered, length),
        "f_quoted": quoted,
        "f_assigned": _matches(F.concat_ws(" ", F.coalesce("before", F.lit("")), F.col("here")), r"^\S*[:=]+ |[:=][\"'`]"),
        "f_secret_name": _matches(F.concat_ws(" ", "before2", "before", "here"), f"(?:^|[^a-z])(?:{SECRET_NAMES})(?:[^a-z]|$)"),
        "f_harmless_name": _matches(F.concat_ws(" ", "before2", "before", "here"), f"(?:^|[^a-z])(?:{HARMLESS_NAMES})(?:[^a-z]|$)"),
        "f_after": _matches(F.col("after"), r"^[\"'`;,)}\]]"),
        "f_example_path": _matches(F.col("path"), EXAMPLE_PATHS),
        "f_path_depth": F.coalesce(F.regexp_count("path", F.lit("[/\\\\]")), F.lit(0)).cast("double"),
    }
    return found.withColumns(columns), list(columns)


def strict_label() -> Column:
    """1 or 0 where the strict rule decides, else null."""
    return F.when((F.col("f_quoted") == 1) & (F.col("f_assigned") == 1) & (F.col("f_secret_name") == 1), 1).when(
        (F.col("f_digits") == 1) | (F.col("f_harmless_name") == 1), 0)


def secret_scan(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text",
                path_col: str = "source", trees: int = TREES, depth: int = DEPTH, training: int = TRAINING) -> DataFrame:
    """One row per candidate: doc_id, word, ordinal, length, candidate_sha256, score, secret.

    ``labelled`` holds findings as ``candidates`` returns them and a column ``label`` (0 or 1).
    """
    found, names = features(candidates(docs, id_col, text_col, path_col))
    found = staged(found, "secret-candidates")
    known = features(labelled)[0] if labelled is not None else found.withColumn("label", strict_label())
    known = known.where(F.col("label").isin(0, 1)).select(*names, F.col("label").cast("double").alias("label"), "candidate").distinct()
    # The bound of the training sample; half of it is kept for each class.
    sample = staged(known.where("label = 1").orderBy(F.xxhash64("candidate")).limit(training // 2).unionAll(
        known.where("label = 0").orderBy(F.xxhash64("candidate")).limit(training // 2)).drop("candidate"), "secret-training")
    result = [F.col("doc_id"), F.col("word").cast("int").alias("word"), F.col("ordinal"), F.length("candidate").alias("length"),
              F.sha2("candidate", 256).alias("candidate_sha256")]
    if sample.select("label").distinct().count() < 2:
        return found.select(*result, F.lit(None).cast("double").alias("score"), F.lit(True).alias("secret"))
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth, seed=7)
    model = Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="features"), forest]).fit(sample)
    scored = model.transform(found.select("doc_id", "word", "ordinal", "candidate", *names))
    score = vector_to_array("probability")[1]
    return scored.select(*result, score.alias("score"), (score >= THRESHOLD).alias("secret"))

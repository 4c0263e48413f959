"""Capture files: each is read, verified and typed, and either gives its pages or goes to quarantine with a reason.

A capture file is named by the SHA-256 of its bytes (``<digest>.json``) and holds one JSON object in canonical form: what was asked
(``request``), when, and the pages received. Files in = files accepted + files refused; of several reasons the first in this
order counts:

``unnamed_file`` no digest in the name; ``checksum_mismatch`` other bytes than the name says; ``not_utf8``; ``invalid_json`` not one
unambiguous object; ``not_canonical`` keys, spaces or escapes written in another way; ``invalid_fields`` a field missing, unknown or of
another type, at any depth; ``invalid_value`` a version, origin or instant that is not allowed; ``invalid_page`` no page, or path,
request id or body not allowed; ``page_outside_capture`` received before the request or after the capture; then the
reasons of the request (``request_reason``).

Types are judged strictly: the shape of the parsed variant is compared, so a number in quotes is not a number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clocks import offset_instant
from ..functions.rules import DIGEST, IDENTIFIER, SYMBOL, first_reason, matches, no, yes
from ..functions.wire import is_canonical
from ..operators.capture import ACTIONS_PATH, BARS_PATH, strict_json_reason
from ..schemas import PAGES, require
from ..session import pin

# Fields and their types, the optional ones last, and the values some of them are restricted to.
_TEXT, _WHOLE = "STRING", "BIGINT"
REQUEST = {
    "schema_version": _WHOLE, "universe": "ARRAY<.*>", "start_session": _TEXT, "end_session": _TEXT, "first_execution_session": _TEXT,
    "warmup_sessions": _WHOLE, "interval": _TEXT, "feed": _TEXT, "adjustment": _TEXT, "aggregation": _TEXT, "zero_volume_policy": _TEXT,
}
INSTRUMENT = {"symbol": _TEXT, "exchange": _TEXT, "listed_on": _TEXT}
INSTRUMENT_DEFAULTS = {"asset_class": "us_etf", "currency": "USD", "calendar": "XNYS", "timezone": "America/New_York"}
CAPTURE = {
    "schema_version": _WHOLE, "adapter_version": _TEXT, "origin": _TEXT, "request": "OBJECT<.*>", "requested_at": _TEXT, "captured_at": _TEXT,
    "pages": "ARRAY<.*>",
}
PAGE = {"schema_version": _WHOLE, "path": _TEXT, "params": rf"OBJECT<(?:[^<>]*: (?:{_TEXT}|{_WHOLE})(?:, |(?=>)))*>", "received_at": _TEXT,
        "request_id": f"(?:{_TEXT}|VOID)", "body": _TEXT}
ALLOWED = {"interval": ("1d",), "feed": ("sip", "iex"), "adjustment": ("raw",), "aggregation": ("regular_session_from_1min",),
           "zero_volume_policy": ("allow_with_warning", "reject")}
ORIGINS = ("historical", "synthetic")
BODY_BYTES = 4_000_000


def _shaped(value: Column, fields: dict[str, str], optional: dict[str, str] | None = None) -> Column:
    """Whether a variant is an object of exactly these fields and types."""
    optional = optional or {}
    if not optional:
        return matches(F.schema_of_variant(value), f"^OBJECT<{', '.join(f'{name}: {kind}' for name, kind in sorted(fields.items()))}>$")
    parts = [f"{name}: {kind}, " if name in fields else f"(?:{name}: {kind}, )?" for name, kind in sorted({**fields, **optional}.items())]
    inside = F.concat(F.regexp_extract(F.schema_of_variant(value), r"^OBJECT<(.*)>$", 1), F.lit(", "))
    return matches(inside, f"^{''.join(parts)}$")


def _text(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "string")


def _day(value: Column, path: str) -> Column:
    text = _text(value, path)
    return F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), text.try_cast("date"))


def _items(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "array<variant>")


def request_reason(value: Column, first_supported: str = "2016-01-01") -> Column:
    """Why a request (a variant) is refused, null for a sound one: ``request_fields``, ``request_version``, ``request_value`` (one of the
    restricted fields, or warm-up below zero), ``request_universe`` (none, an unsound or a repeated instrument), ``request_dates`` (not
    first supported day <= start <= first execution <= end, each an ISO day)."""
    tests = [_text(value, f"$.{name}").isin(*values) for name, values in ALLOWED.items()]
    tests.append(F.try_variant_get(value, "$.warmup_sessions", "bigint") >= 0)
    allowed = tests[0]
    for test in tests[1:]:
        allowed = allowed & test
    universe = _items(value, "$.universe")
    symbols = F.transform(universe, lambda i: _text(i, "$.symbol"))

    def sound(item: Column) -> Column:
        fine = _shaped(item, INSTRUMENT, {**{n: _TEXT for n in INSTRUMENT_DEFAULTS}, "delisted_on": f"(?:{_TEXT}|VOID)"})
        fine = fine & matches(_text(item, "$.symbol"), SYMBOL) & matches(_text(item, "$.exchange"), IDENTIFIER)
        for name, only in INSTRUMENT_DEFAULTS.items():
            fine = fine & (F.coalesce(_text(item, f"$.{name}"), F.lit(only)) == only)
        listed, delisted = _day(item, "$.listed_on"), _day(item, "$.delisted_on")
        return fine & listed.isNotNull() & (_text(item, "$.delisted_on").isNull() | F.coalesce(delisted > listed, F.lit(False)))

    start, execution, end = (_day(value, f"$.{n}") for n in ("start_session", "first_execution_session", "end_session"))
    return first_reason([
        ("request_fields", ~_shaped(value, REQUEST)),
        ("request_version", no(F.try_variant_get(value, "$.schema_version", "bigint") == 1)),
        ("request_value", no(allowed)),
        ("request_universe", no((F.size(universe) > 0) & F.forall(universe, sound) & (F.size(F.array_distinct(symbols)) == F.size(symbols)))),
        ("request_dates", no((F.lit(first_supported).cast("date") <= start) & (start <= execution) & (execution <= end))),
    ])


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder as (path, content), bytes unchanged. Spark's readers leave out files without bytes: those give no row."""
    return pin(spark).read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")


def judged_files(files: DataFrame, adapter_version: str | None = None, first_supported: str = "2016-01-01") -> DataFrame:
    """One row per file: path, capture_id, digest, bytes, body, and ``reason``, null for an accepted file.

    With ``adapter_version`` only captures of that version are accepted.
    """
    named = files.select(
        "path", F.nullif(F.regexp_extract("path", r"([a-f0-9]{64})\.json$", 1), F.lit("")).alias("capture_id"), F.sha2("content", 256).alias("digest"),
        F.octet_length("content").alias("bytes"), F.try_validate_utf8(F.col("content").cast("string")).alias("body"))
    v, pages = F.col("__v"), F.col("__pages")
    # Columns of their own, so that a body is parsed once and not by every rule that looks at it.
    parsed = named.withColumn("__v", F.try_parse_json("body")).withColumns({
        "__canonical": yes(is_canonical(F.col("body"), v)) & F.startswith(F.col("body"), F.lit("{")),
        "__pages": _items(v, "$.pages"), "__request": F.try_variant_get(v, "$.request", "variant"),
        "__asked": offset_instant(_text(v, "$.requested_at")), "__done": offset_instant(_text(v, "$.captured_at"))})
    instant = lambda value, path: offset_instant(_text(value, path))
    page_fine = lambda p: (
        (F.try_variant_get(p, "$.schema_version", "bigint") == 1) & _text(p, "$.path").isin(BARS_PATH, ACTIONS_PATH)
        & (F.coalesce(F.length(_text(p, "$.request_id")), F.lit(0)) <= 128) & F.length(_text(p, "$.body")).between(2, BODY_BYTES)
        & instant(p, "$.received_at").isNotNull())
    asked, done = F.col("__asked"), F.col("__done")
    version = _text(v, "$.adapter_version")
    return parsed.withColumn("reason", F.coalesce(first_reason([
        ("unnamed_file", no(F.col("capture_id").rlike(DIGEST))),
        ("checksum_mismatch", no(F.col("capture_id") == F.col("digest"))),
        ("not_utf8", F.col("body").isNull()),
        # A canonical object is strict: one value, each key once, every number whole.
        ("invalid_json", ~F.col("__canonical") & strict_json_reason(F.col("body")).isNotNull()),
        ("not_canonical", ~F.col("__canonical")),
        ("invalid_fields", ~_shaped(v, CAPTURE) | no(F.forall(pages, lambda p: _shaped(p, PAGE)))),
        ("invalid_value", no((F.try_variant_get(v, "$.schema_version", "bigint") == 1) & _text(v, "$.origin").isin(*ORIGINS)
                             & (matches(version, IDENTIFIER) if adapter_version is None else version == adapter_version)
                             & asked.isNotNull() & done.isNotNull())),
        ("invalid_page", no((F.size(pages) > 0) & F.forall(pages, page_fine))),
        ("page_outside_capture", no(F.forall(pages, lambda p: instant(p, "$.received_at").between(asked, done)))),
    ]), request_reason(F.col("__request"), first_supported))).drop("__v", "__canonical", "__pages", "__request", "__asked", "__done")


def quarantine(judged: DataFrame) -> DataFrame:
    """Refused files: path, capture_id, digest, bytes, reason."""
    return judged.where("reason IS NOT NULL").select("path", "capture_id", "digest", "bytes", "reason")


def accepted_pages(judged: DataFrame) -> DataFrame:
    """The pages of accepted files, in the columns of ``schemas.PAGES``; ``seq`` is the place in the file. A file that is there under
    several paths counts once."""
    files = judged.where("reason IS NULL").groupBy("capture_id").agg(F.any_value("body").alias("body"))
    pages = files.select("capture_id", F.posexplode(_items(F.try_parse_json("body"), "$.pages")).alias("seq", "page"))
    page = F.col("page")
    return require(pages.select(
        "capture_id", F.col("seq").cast("bigint").alias("seq"), _text(page, "$.path").alias("path"),
        F.try_variant_get(page, "$.params", "map<string,string>").alias("params"), offset_instant(_text(page, "$.received_at")).alias("received_at"),
        _text(page, "$.request_id").alias("request_id"), _text(page, "$.body").alias("body")), PAGES)

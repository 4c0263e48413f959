"""Redaction and character spans over whole texts."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MASK = "[REDACTED]"
# What counts as a secret field, an authorization header and a quoted value.
QUOTED = r"""(?:"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')"""
SECRET_FIELD = (
    r"(?i)([\"']?\b(?:[a-z0-9_]*api_?key|[a-z0-9_]*api_?secret|[a-z0-9_]*token|[a-z0-9_]*password|secret)[\"']?\s*[:=]\s*)(?:"
    + QUOTED + r"|\[REDACTED\]|[^\s,;}\]]+)"
)
FIELD_WORDS = ("apikey", "api_key", "apisecret", "api_secret", "token", "password", "secret")
AUTHORIZATION = r"(?im)([\"']?\bauthorization[\"']?\s*[:=]\s*)(?:" + QUOTED + r"|[^\r\n]+)"


def _quoted_literal(value: str, quote: str) -> str:
    """The value as it stands between ``quote`` characters in source code."""
    named = {"\n": "\\n", "\r": "\\r", "\t": "\\t", "\\": "\\\\", quote: "\\" + quote}

    def written(char: str) -> str:
        code = ord(char)
        if char in named or char.isprintable():
            return named.get(char, char)
        return f"\\x{code:02x}" if code < 256 else f"\\u{code:04x}" if code < 65536 else f"\\U{code:08x}"

    return "".join(map(written, value))


def known_values_pattern(secrets: Sequence[str]) -> str | None:
    """One alternation over known values as plain text, JSON text and quoted literal; None without values.

    At one place the first alternative wins, so longer spellings stand first and a value that begins like another is masked whole.
    """
    forms = {form for value in secrets if value for form in (
        value, json.dumps(value)[1:-1], json.dumps(value, ensure_ascii=False)[1:-1], _quoted_literal(value, "'"), _quoted_literal(value, '"'))}
    return "|".join(re.escape(form) for form in sorted(sorted(forms), key=len, reverse=True)) or None


def redact(text: Column, secrets: Sequence[str] = ()) -> Column:
    """Mask known values, authorization headers and secret fields, in that order, in the whole text.

    Both patterns contain a fixed word. Looking for the words first is a plain byte search, so texts without them,
    nearly all, never meet the backtracking patterns; the result is the same.
    """
    known = known_values_pattern(secrets)
    if known:
        text = F.regexp_replace(text, known, MASK)
    lowered = F.lower(text)
    named = F.contains(lowered, F.lit(FIELD_WORDS[0]))
    for word in FIELD_WORDS[1:]:
        named = named | F.contains(lowered, F.lit(word))
    header = F.contains(lowered, F.lit("authorization"))
    with_headers = F.regexp_replace(text, AUTHORIZATION, "$1" + MASK)
    fields = lambda value: F.regexp_replace(value, SECRET_FIELD, "$1" + MASK)
    return F.when(header, fields(with_headers)).when(named, fields(text)).otherwise(text)


def _redact_value(column: Column, kind: T.DataType, secrets: Sequence[str]) -> Column:
    if isinstance(kind, T.StringType):
        return redact(column, secrets)
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda item: _redact_value(item, kind.elementType, secrets))
    if isinstance(kind, T.MapType):
        return F.transform_values(column, lambda _, item: _redact_value(item, kind.valueType, secrets))
    if isinstance(kind, T.StructType):
        parts = [_redact_value(column[f.name], f.dataType, secrets).alias(f.name) for f in kind]
        return F.when(column.isNotNull(), F.struct(*parts))
    return column


def redact_columns(df: DataFrame, columns: Sequence[str] | None = None, secrets: Sequence[str] = ()) -> DataFrame:
    """Apply the redaction to every string in the named columns, nested ones included."""
    chosen = set(columns or df.columns)
    return df.select(
        *[
            _redact_value(F.col(f.name), f.dataType, secrets).alias(f.name) if f.name in chosen else F.col(f.name)
            for f in df.schema
        ]
    )


def characters(text: Column, start: Column, end: Column) -> Column:
    """Characters ``[start, end)`` counted from zero."""
    return F.substring(text, start + 1, end - start)

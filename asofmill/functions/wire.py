"""Canonical form and digest of JSON texts of any shape: keys sorted at every depth, digits of numbers kept.

Spark's readers turn numbers into doubles on the way, so numbers that a double or a long could not carry are first rewritten as
marked texts (``marked``). The variant parser then sorts keys at every depth and refuses repeated ones, whatever the shape, and
the marks are taken out again. In the canonical form a number with a point or an exponent is a text of its exact decimal value
(at most one digit before an exponent, ``E+2``), a whole number stands as it is, and everything outside printable ASCII is
escaped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .identity import sha256

#: Strings, numbers, and what lies between them: every character of a JSON text is in exactly one token.
_TOKENS = r'"(?:\\.|[^"\\])*"|-?[0-9][0-9.eE+\-]*|[^"0-9\-]+|[-"]'
#: Whole numbers of more digits may not fit a long.
_LONG_DIGITS = 18
#: What a text to be marked holds somewhere: a digit before a point or an exponent, very many digits, or a ``#`` after a quote. Inside
#: strings it may hold these too, and then marking leaves it as it is; few texts have none of them in vain.
_TO_MARK = rf'[0-9][.eE]|[0-9]{{{_LONG_DIGITS + 1}}}|"(?:#|\\u0023)'


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row: an expression that is used several times is otherwise repeated, and so
    is all that it is made of."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _decimal_text(number: Column) -> Column:
    """The exact value of a JSON number: all digits kept, an exponent only where it is positive or below the sixth zero."""
    part = lambda n: F.regexp_extract(number, r"^(-?)([0-9]+)(?:\.([0-9]+))?(?:[eE]([+-]?[0-9]+))?$", n)
    shifted = F.coalesce(part(4).try_cast("int"), F.lit(0)) - F.length(part(3))
    digits = F.regexp_replace(F.concat(part(2), part(3)), "^0+(?=[0-9])", "")
    return once(F.struct(part(1).alias("sign"), digits.alias("digits"), shifted.alias("exponent")), _placed_digits)


def _placed_digits(number: Column) -> Column:
    """A sign, digits and an exponent as text."""
    digits, exponent = number["digits"], number["exponent"]
    count = F.length(digits)
    before = exponent + count  # digits before the point
    point = F.when((exponent <= 0) & (before > -6), before).otherwise(F.lit(1))
    body = (
        F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
        .when(point >= count, F.concat(digits, F.repeat(F.lit("0"), point - count)))
        .otherwise(F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, count)))
    )
    shift = before - point
    tail = F.when(shift == 0, "").otherwise(F.concat(F.lit("E"), F.when(shift > 0, "+").otherwise(""), shift.cast("string")))
    return F.concat(number["sign"], body, tail)


def marked(text: Column) -> Column:
    """A JSON text in which every number survives any reader: ``#f`` and ``#i`` texts stand for numbers, and a text that began
    with ``#`` begins with two of them."""

    def token(t: Column) -> Column:
        return (
            F.when(F.startswith(t, F.lit('"')), F.regexp_replace(t, r'^"(#|\\u0023)', '"#$1'))
            .when(t.rlike("^-?[0-9].*[.eE]"), F.concat(F.lit('"#f'), _decimal_text(t), F.lit('"')))
            .when(t.rlike(f"^-?[0-9]{{{_LONG_DIGITS + 1},}}$"), F.concat(F.lit('"#i'), t, F.lit('"')))
            .otherwise(t)
        )

    def tokens(t: Column) -> Column:
        return F.array_join(F.transform(F.regexp_extract_all(t, F.lit(_TOKENS), F.lit(0)), token), "")

    return once(text, lambda t: F.when(t.rlike(_TO_MARK), tokens(t)).otherwise(t))


def _unmarked(text: Column) -> Column:
    # A mark opens a text, so no backslash stands before its quote.
    whole = F.regexp_replace(text, r'(?<!\\)"#i(-?[0-9]+)"', "$1")
    plain = F.regexp_replace(F.regexp_replace(whole, r'(?<!\\)"#f', '"'), r'(?<!\\)"##', '"#')
    return F.when(F.contains(text, F.lit('"#')), plain).otherwise(text)


def _ascii(text: Column) -> Column:
    """Everything outside printable ASCII as ``\\u`` and four small hexadecimal digits, beyond the first plane as a pair."""
    unit = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))

    def token(t: Column) -> Column:
        point = F.ascii(t)
        pair = F.concat(unit(F.lit(0xD7C0) + F.shiftright(point, 10)), unit(F.lit(0xDC00) + point.bitwiseAND(F.lit(0x3FF))))
        return (
            F.when(F.startswith(t, F.lit("\\u")), F.lower(t))
            .when((point >= 0x20) & (point <= 0x7E), t).when(point > 0xFFFF, pair).otherwise(unit(point))
        )

    tokens = F.regexp_extract_all(text, F.lit(r"\\u[0-9A-Fa-f]{4}|\\[^u]|[\x20-\x5b\x5d-\x7e]+|[^\x20-\x7e]"), F.lit(0))
    return F.when(text.rlike(r"[^\x20-\x7e]|\\u"), F.array_join(F.transform(tokens, token), "")).otherwise(text)


def canonical_marked(text: Column) -> Column:
    """Canonical form of a text ``marked`` has gone over; null if it is no JSON or repeats a key."""
    return once(F.to_json(F.try_parse_json(text)), lambda t: once(_unmarked(t), _ascii))


def canonical_text(text: Column) -> Column:
    """Canonical form of a JSON text."""
    return canonical_marked(marked(text))


def is_canonical(text: Column, parsed: Column) -> Column:
    """Whether a text is its own canonical form; ``parsed`` is its variant. Null if it is no JSON or repeats a key.

    A text of plain characters without marks, escapes by number and numbers to be rewritten is canonical if the variant is
    written as that text.
    """
    special = text.rlike(rf"{_TO_MARK}|[^\x20-\x7e]|\\u")
    return F.when(special, canonical_text(text) == text).otherwise(F.to_json(parsed) == text)


def wire_hash(text: Column) -> Column:
    """SHA-256 of the canonical form: the same for texts that differ in the order of keys, spaces or escapes only."""
    return sha256(canonical_text(text))


def _may_be_inexact(places: int) -> str:
    return rf"[0-9][eE]|\.[0-9]{{{places + 1}}}"


#: What a text holds in which a number has a digit past the 18th place.
MAY_BE_INEXACT = _may_be_inexact(18)


def inexact(outside_strings: Column, places: int = 18) -> Column:
    """Whether any number of a JSON text (with its strings taken out) has a digit past so many decimal places, judged by value."""

    def beyond(t: Column) -> Column:
        part = lambda n: F.regexp_extract(t, r"^-?([0-9]+)(?:\.([0-9]+))?(?:[eE]([+-]?[0-9]+))?$", n)
        digits = F.concat(part(1), part(2))
        kept = F.length(F.regexp_replace(digits, "0+$", ""))
        return (kept > 0) & (F.length(part(2)) - (F.length(digits) - kept) - F.coalesce(part(3).try_cast("int"), F.lit(0)) > places)

    numbers = F.regexp_extract_all(outside_strings, F.lit(r"-?[0-9][0-9.eE+\-]*"), F.lit(0))
    # Few bodies hold such numbers at all; only those are looked at one by one.
    return F.when(outside_strings.rlike(_may_be_inexact(places)), F.exists(numbers, beyond)).otherwise(F.lit(False))

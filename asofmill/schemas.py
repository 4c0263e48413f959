"""Fixed, versioned table schemas. Nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

VERSION = 1
NUMBER = T.DecimalType(24, 8)


def _schema(tag: str, *fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, null, {"schema": tag}) for n, t, null in fields])


_S, _D, _TS, _L, _B = T.StringType(), T.DateType(), T.TimestampType(), T.LongType(), T.ByteType()

BARS = _schema(
    "market_observation.v1",
    ("schema_version", _B, False), ("symbol", _S, False), ("session", _D, False), ("interval", _S, False),
    ("interval_start", _TS, False), ("interval_end", _TS, False), ("available_at", _TS, False),
    ("first_ingested_at", _TS, False), ("provider", _S, False), ("feed", _S, False), ("revision_id", _S, False),
    ("origin", _S, False), ("adjustment", _S, False), ("currency", _S, False), ("open", NUMBER, False),
    ("high", NUMBER, False), ("low", NUMBER, False), ("close", NUMBER, False), ("volume", _L, False),
)
ACTIONS = _schema(
    "corporate_action.v1",
    ("schema_version", _B, False), ("action_id", _S, False), ("symbol", _S, False), ("kind", _S, False),
    ("effective_session", _D, False), ("available_at", _TS, False), ("first_ingested_at", _TS, False),
    ("revision_id", _S, False), ("split_ratio", _L, True), ("cash_amount_usd", NUMBER, True), ("pay_date", _D, True),
)
SESSIONS = _schema(
    "trading_session.v1", ("session", _D, False), ("market_open", _TS, False), ("market_close", _TS, False)
)
UNIVERSE = _schema(
    "instrument.v1",
    ("symbol", _S, False), ("exchange", _S, False), ("listed_on", _D, False), ("delisted_on", _D, True),
)
PAGES = T.StructType([
    T.StructField("capture_id", _S, False), T.StructField("seq", _L, False), T.StructField("path", _S, False),
    T.StructField("params", T.MapType(_S, _S), True), T.StructField("received_at", _TS, True),
    T.StructField("request_id", _S, True), T.StructField("body", _S, True),
])
FEATURES_CSV = T.StructType([
    T.StructField("session", _D), T.StructField("available_at", _S), T.StructField("feature_close", NUMBER),
    T.StructField("instruction", _S),
])
DAILY_CSV = T.StructType([
    T.StructField("session", _D), *[T.StructField(n, NUMBER) for n in ("open", "high", "low", "close")],
    T.StructField("volume", _L), T.StructField("stock_splits", _L), T.StructField("dividend", NUMBER),
])


class SchemaMismatch(ValueError):
    """A stored table does not have the declared columns."""


def require(df: DataFrame, expected: T.StructType) -> DataFrame:
    """Compare names, order and types; nullability is a property of the files, not of the contract."""
    actual = [(f.name, f.dataType.simpleString()) for f in df.schema]
    wanted = [(f.name, f.dataType.simpleString()) for f in expected]
    if actual != wanted:
        raise SchemaMismatch(f"expected {wanted}, found {actual}")
    return df

"""Replay of fills, splits and dividends into position, cash, receivable and equity.

A sleeve is one symbol held by one account, with its own cash. Quantities are summed in the share units after the last
split (``quantity x later ratios``, always whole) and divided back to the units of each session, so a split needs no
rewrite of history and positions stay exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joins import small_side
from ..functions.ordered import HOT_ROWS, hot_keys, running_sums
from .calendars import calendar_of, sessions_before
from .pointintime import split_factor, split_schedule

# Order of events inside a session.
RANK = {"split": 0, "entitlement": 1, "payment": 2, "open": 3, "fill": 4}
_MONEY = "decimal(28,8)"


def payment_sessions(dividends: DataFrame, sessions: DataFrame) -> DataFrame:
    """Dividends with the first session on or after their pay date; null while the calendar does not reach it."""
    calendar = calendar_of(sessions)
    positions = calendar.sessions.select((F.col("ordinal") - 1).alias("__before"), F.col("session").alias("pay_session"))
    counted = sessions_before(dividends, calendar, "pay_date", "__before")
    return counted.join(F.broadcast(positions), "__before", "left").drop("__before")


def _schedule(splits: DataFrame) -> DataFrame:
    return split_schedule(splits.withColumn("available_at", F.lit(None).cast("timestamp")))


def _events(df: DataFrame, kind: str, **columns: Column) -> DataFrame:
    defaults = {
        "quantity": F.lit(0).cast("bigint"), "cash_delta": F.lit(0).cast(_MONEY), "receivable_delta": F.lit(0).cast(_MONEY),
        "amount": F.lit(None).cast(_MONEY), "action_id": F.lit(None).cast("string"), "seq": F.lit(0).cast("bigint"),
    }
    return df.select(
        "account", "symbol", "session", F.lit(RANK[kind]).alias("rank"), F.lit(kind).alias("event"),
        *[columns.get(name, default).alias(name) for name, default in defaults.items()],
    )


def _scaled(events: DataFrame, schedule: DataFrame) -> DataFrame:
    """Quantities in the share units after the last split; ``__later`` leads back to the units of the session."""
    joined = events.join(schedule, "symbol", "left").withColumn("__later", split_factor(F.col("session"))).drop("__splits")
    return joined.withColumn("__scaled", F.col("quantity") * F.col("__later"))


def entitlements(fills: DataFrame, splits: DataFrame, dividends: DataFrame) -> DataFrame:
    """Dividend entitlements: shares held at the ex-date's open, after a same-session split, times the amount.

    ``dividends`` has symbol, action_id, ex_session, amount and pay_session. Each fill belongs to the gap between two
    ex-dates of its symbol. Fills are summed per gap before the shuffle, so a sleeve is left with at most one row per
    dividend, and a running sum over those rows gives the position at every ex-date.
    """
    due = dividends.groupBy("symbol").agg(F.array_sort(F.collect_list(
        F.struct("ex_session", "action_id", F.col("amount").cast(_MONEY).alias("amount"), "pay_session")
    )).alias("__due"))
    due = small_side(due, dividends)
    passed = F.size(F.filter("__due", lambda d: d["ex_session"] <= F.col("session")))
    gaps = (
        _scaled(fills.join(due, "symbol"), _schedule(splits))
        .withColumn("__gap", passed).where(F.col("__gap") < F.size("__due"))
        .groupBy("account", "symbol", "__gap").agg(F.sum("__scaled").alias("__sum"))
    )
    per_sleeve = Window.partitionBy("account", "symbol").orderBy("__gap")
    until = gaps.select(
        "account", "symbol", "__gap", F.sum("__sum").over(per_sleeve).alias("__held"), F.lead("__gap").over(per_sleeve).alias("__next"),
    ).join(due, "symbol")
    dated = until.withColumn(
        "__index", F.explode(F.sequence(F.col("__gap"), F.coalesce("__next", F.size("__due")) - 1))
    ).withColumn("__d", F.get("__due", F.col("__index"))).select(
        "account", "symbol", "__held", F.col("__d.ex_session").alias("session"), F.col("__d.action_id").alias("action_id"),
        F.col("__d.pay_session").alias("pay_session"), F.col("__d.amount").alias("amount"),
    )
    placed = dated.join(_schedule(splits), "symbol", "left").withColumn("__later", split_factor(F.col("session")))
    return placed.withColumn("position", F.expr("__held div __later")).where(F.col("position") != 0).select(
        "account", "symbol", "action_id", F.col("session").alias("ex_session"), "pay_session", "position",
        (F.col("position") * F.col("amount")).cast(_MONEY).alias("amount"),
    )


def _dividend_events(held: DataFrame) -> DataFrame:
    """Entitlement and payment rows of each dividend, from one reading of the entitlements."""
    nothing = F.lit(0).cast(_MONEY)
    row = lambda session, kind, cash, receivable: F.struct(
        session.alias("session"), F.lit(RANK[kind]).alias("rank"), F.lit(kind).alias("event"),
        cash.alias("cash_delta"), receivable.alias("receivable_delta"),
    )
    amount = F.col("amount")
    both = F.array(
        row(F.col("ex_session"), "entitlement", nothing, amount),
        row(F.col("pay_session"), "payment", amount, (-amount).cast(_MONEY)),
    )
    return held.withColumn("__e", F.explode(both)).where(F.col("__e.session").isNotNull()).select(
        "account", "symbol", "__e.session", "__e.rank", "__e.event", F.lit(0).cast("bigint").alias("quantity"),
        "__e.cash_delta", "__e.receivable_delta", "amount", "action_id", F.lit(0).cast("bigint").alias("seq"),
    )


def ledger_replay(
    fills: DataFrame, splits: DataFrame, dividends: DataFrame, marks: DataFrame, initial_cash: Column | DataFrame,
    snapshots: DataFrame | None = None, slice_by: Column | None = None, hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """One row per event of a sleeve with position, cash, receivable and equity after it.

    ``fills`` has account, symbol, session, seq, signed whole quantity, price and commission; ``marks`` has symbol,
    session and mark. Receivables count in equity, never in cash. ``snapshots`` (account, symbol, session) adds rows
    for the state at a session's open: after splits and dividends, before orders.
    """
    slice_column = slice_by if slice_by is not None else F.trunc("session", "MM")
    sleeve = ["account", "symbol"]
    value = F.col("quantity") * F.col("price").cast("decimal(18,8)")
    rows = _events(
        fills, "fill", quantity=F.col("quantity"), seq=F.col("seq"),
        cash_delta=(-(value + F.col("commission").cast("decimal(18,8)"))).cast(_MONEY),
    ).unionByName(_dividend_events(entitlements(fills, splits, dividends)))
    rows = rows.unionByName(_events(_sleeves_at_splits(fills, splits), "split"))
    if snapshots is not None:
        rows = rows.unionByName(_events(snapshots, "open"))
    placed = running_sums(
        _scaled(rows, _schedule(splits)), sleeve, [F.col("session"), F.col("rank"), F.col("seq"), F.col("action_id")],
        {"__held": F.col("__scaled"), "__cash": F.col("cash_delta"), "__receivable": F.col("receivable_delta")},
        slice_column, hot_rows, hot=None if hot_rows is None else hot_keys(fills, sleeve, hot_rows),
    ).withColumn("position", F.expr("__held div __later"))
    placed = placed.where((F.col("event") != "split") | (F.col("position") != 0))
    if isinstance(initial_cash, DataFrame):
        placed = placed.join(initial_cash, "account", "left").withColumnRenamed("cash", "__cash0")
    else:
        placed = placed.withColumn("__cash0", initial_cash.cast(_MONEY))
    cash = (F.coalesce(F.col("__cash0").cast(_MONEY), F.lit(0).cast(_MONEY)) + F.col("__cash")).cast(_MONEY)
    receivable = F.col("__receivable").cast(_MONEY)
    marked = placed.join(marks.select("symbol", "session", F.col("mark").cast("decimal(18,8)").alias("mark")),
                         ["symbol", "session"], "left")
    return marked.select(
        "account", "symbol", "session", "rank", "seq", "event", "quantity", "position", cash.alias("cash"),
        receivable.alias("receivable"), "mark",
        (cash + receivable + (F.col("position") * F.col("mark"))).cast(_MONEY).alias("equity"),
    )


def _sleeves_at_splits(fills: DataFrame, splits: DataFrame) -> DataFrame:
    """The splits each sleeve lives through, as its sessions."""
    sleeves = fills.groupBy("account", "symbol").agg(F.min("session").alias("__first"))
    dated = splits.select("symbol", F.col("effective_session").alias("session"))
    return sleeves.join(small_side(dated), "symbol").where(F.col("session") > F.col("__first")).drop("__first")


def average_buy_price(
    fills: DataFrame, splits: DataFrame, slice_by: Column | None = None, hot_rows: int | None = HOT_ROWS
) -> DataFrame:
    """Average price of everything bought so far, in the share units of the row's session."""
    slice_column = slice_by if slice_by is not None else F.trunc("session", "MM")
    sleeve = ["account", "symbol"]
    bought = fills.where(F.col("quantity") > 0).select(
        *sleeve, "session", "seq", "quantity", (F.col("quantity") * F.col("price").cast("decimal(18,8)")).cast(_MONEY).alias("__cost")
    )
    at_split = _sleeves_at_splits(fills, splits).select(
        *sleeve, "session", F.lit(-1).cast("bigint").alias("seq"), F.lit(0).cast("bigint").alias("quantity"),
        F.lit(0).cast(_MONEY).alias("__cost"),
    )
    summed = running_sums(
        _scaled(bought.unionByName(at_split), _schedule(splits)), sleeve, [F.col("session"), F.col("seq")],
        {"__n": F.col("__scaled"), "__total": F.col("__cost")}, slice_column, hot_rows,
        hot=None if hot_rows is None else hot_keys(fills, sleeve, hot_rows),
    )
    units = F.expr("__n div __later")
    return summed.where(F.col("__n") > 0).select(
        "account", "symbol", "session", "seq", "quantity", units.alias("bought_quantity"),
        F.bround(F.col("__total").cast("decimal(28,8)") / units.cast("decimal(18,0)"), 8).cast("decimal(24,8)").alias("average_price"),
    )


def unpaid(held: DataFrame, as_of: Column) -> DataFrame:
    """Receivable per account at a date: entitled by then and not yet paid."""
    open_now = (F.col("ex_session") <= as_of) & (F.col("pay_session").isNull() | (F.col("pay_session") > as_of))
    return held.where(open_now).groupBy("account").agg(F.sum("amount").cast(_MONEY).alias("receivable"))

"""Captured source pages: decoding, completeness, row-level rejects, corporate actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clocks import exchange_date, is_whole_minute, offset_instant, session_date
from ..functions.exact import as_number, is_whole, whole
from ..functions.identity import content_versions, sha256
from ..functions.joins import small_side
from ..functions.ordered import previous_values
from ..functions.rules import differs, first_reason, yes
from ..functions.wire import MAY_BE_INEXACT, canonical_marked, inexact, marked
from ..session import staged

BARS_PATH = "/v2/stocks/bars"
ACTIONS_PATH = "/v1/corporate-actions"

# Wire fields of a minute and of a page. Decimal fields keep every digit; text fields would not.
_MINUTE = "struct<t:string,o:decimal(38,18),h:decimal(38,18),l:decimal(38,18),c:decimal(38,18),v:decimal(38,18)>"
BARS_BODY = f"bars map<string,array<{_MINUTE}>>, next_page_token string"
_ACTION = (
    "struct<id:string,symbol:string,process_date:string,ex_date:string,effective_date:string,payable_date:string,"
    "old_rate:decimal(38,18),new_rate:decimal(38,18),rate:decimal(38,18),special:boolean,foreign:boolean,"
    "due_bill_redemption_date:string,due_bill_on_date:string,due_bill_off_date:string>"
)
ACTIONS_BODY = f"corporate_actions map<string,array<{_ACTION}>>, next_page_token string"
MINUTE_FIELDS = ("t", "o", "h", "l", "c", "v")
SUPPORTED_KINDS = ("forward_splits", "cash_dividends")


def strict_json_reason(text: Column) -> Column:
    """Why a text is not one valid and unambiguous JSON object: non-finite number, malformed, a key repeated at any depth, a
    number whose value has digits past the 18th place, whether written with an exponent or without.

    Spark's parsers stop after the first value, so the text is also read inside an array and inside an object: whatever
    follows the value breaks one of the two.
    """
    outside_strings = F.regexp_replace(text, r'"(?:\\.|[^"\\])*"', '""')
    # What a text does not hold at all it does not hold outside its strings; few have to be looked at more closely.
    non_finite = text.rlike("NaN|Infinity") & outside_strings.rlike(r"(?:^|[:\[,\s])-?(?:NaN|Infinity)(?:$|[\],}\s])")
    listed = F.concat(F.lit("["), text, F.lit("]"))
    alone = (F.json_array_length(listed) == 1) & (F.size(F.json_object_keys(F.concat(F.lit('{"w":'), text, F.lit("}")))) == 1)
    return (
        F.when(yes(non_finite), "non_finite_number")
        .when(~yes(alone) | F.json_object_keys(text).isNull(), "malformed")
        .when(F.try_parse_json(listed).isNull(), "duplicate_key")
        .when(text.rlike(MAY_BE_INEXACT) & yes(inexact(outside_strings)), "inexact_number")
    )


def page_rejects(pages: DataFrame) -> DataFrame:
    """Add ``reason`` and ``token`` to pages: what is wrong with the shape of a body, in checking order."""
    group = F.when(F.col("path") == BARS_PATH, F.lit("bars")).otherwise(F.lit("corporate_actions"))
    # Columns of their own, so that a body is read once for each and not by every rule. A body that is no object has no keys; the
    # strict reading below says why.
    read = pages.withColumns({
        "__names": F.json_object_keys("body"),
        "__group": F.when(F.col("path") == BARS_PATH, F.get_json_object("body", "$.bars")).otherwise(F.get_json_object("body", "$.corporate_actions")),
        # A raw token keeps its quotes, which tells text from a number.
        "__token": F.regexp_extract("body", r'"next_page_token"\s*:\s*("(?:\\.|[^"\\])*"|[^,}\s]+)', 1),
    }).withColumn("__lists", F.from_json("__group", "map<string,array<string>>"))
    names, raw_group, raw_token, lists = (F.col(n) for n in ("__names", "__group", "__token", "__lists"))
    token = F.get_json_object("body", "$.next_page_token")
    is_text = raw_token.startswith('"')
    shaped = F.coalesce(F.substring(F.ltrim(raw_group), 1, 1) == "{", F.lit(True))
    valued = F.coalesce(
        F.exists(F.map_values(F.coalesce(lists, F.map_from_arrays(F.array().cast("array<string>"),
                                                                F.array().cast("array<array<string>>")))),
                 lambda v: F.coalesce(F.size(v) > 0, F.lit(False))), F.lit(False))
    list_fault = ~shaped | F.coalesce(F.exists(F.map_values(lists), lambda v: v.isNull()), F.lit(False)) | (
        raw_group.isNotNull() & lists.isNull()
    )
    strict = strict_json_reason(F.col("body"))
    rowless = F.exists(F.map_values(lists), lambda rows: F.exists(rows, lambda row: F.coalesce(
        ~F.startswith(F.ltrim(row), F.lit("{")) | F.json_object_keys(row).isNull(), F.lit(True))))
    reason = first_reason([
        ("invalid_response", strict.isNotNull()),
        ("incomplete_response", ~yes(F.array_contains(names, group) & F.array_contains(names, F.lit("next_page_token")))),
        ("invalid_response", list_fault | yes(rowless)),
        ("invalid_pagination", (raw_token != "null") & (~is_text | ~F.length(token).between(1, 4096))),
        ("empty_page", (raw_token != "null") & ~valued),
    ])
    judged = read.withColumn("token", F.when(raw_token != "null", token)).withColumn("reason", reason)
    return judged.drop("__names", "__group", "__token", "__lists")


def minute_rows(pages: DataFrame) -> DataFrame:
    """One row per wire minute with its arrival position: page number, symbol within page, position in the list.

    Pages that ``page_rejects`` refuses may have no rows here; ``capture_verdicts`` accounts for every page.
    """
    bars = pages.where(F.col("path") == BARS_PATH)
    decoded = bars.withColumn("__body", F.from_json("body", BARS_BODY))
    # The outer form of explode: for the plain one the optimizer adds a filter that parses every body once more.
    by_symbol = decoded.select(
        "capture_id", "seq", "params", "received_at",
        F.explode_outer(F.col("__body.bars")).alias("symbol", "__rows"),
    )
    return by_symbol.select(
        "capture_id", "seq", F.col("params")["start"].alias("requested_start"), "received_at", "symbol",
        F.posexplode_outer("__rows").alias("pos", "__m"),
    ).where(F.col("pos").isNotNull()).select(
        "capture_id", "seq", "requested_start", "received_at", "symbol", "pos",
        F.col("__m.t").alias("t_text"),
        *[F.col(f"__m.{c}").alias(f"{c}_wide") for c in MINUTE_FIELDS[1:]],
    )


def typed_minutes(rows: DataFrame) -> DataFrame:
    """Wire values as exact numbers, whole volume and instants; a value that cannot be exact becomes null."""
    return rows.select(
        "*", offset_instant(F.col("t_text")).alias("t"),
        *[as_number(F.col(f"{c}_wide")).alias(c) for c in ("o", "h", "l", "c")], whole(F.col("v_wide")).alias("v"),
    )


def classify_minutes(minutes: DataFrame, sessions: DataFrame, universe: DataFrame) -> DataFrame:
    """Add ``reject_reason``: the first rule each minute breaks, null for accepted rows.

    Order is judged against the row that arrived just before in the same requested day. Pages are bounded, so the
    page number is the slice within which rows are sorted. A repeated (symbol, time) is rejected from its second
    arrival on; the first arrival per key is an aggregate, not a ranking window over a possibly hot key.
    """
    typed = typed_minutes(minutes).withColumn("requested_day", exchange_date(F.try_to_timestamp("requested_start")))
    arrival = ["seq", "symbol", "pos"]
    ordered = previous_values(
        typed, ["capture_id", "requested_day"], arrival,
        {"__prev_symbol": F.col("symbol"), "__prev_t": F.col("t")}, F.col("seq"), hot_rows=None,
    )
    firsts = (
        typed.where(F.col("t").isNotNull()).groupBy("capture_id", "symbol", "t")
        .agg(F.count(F.lit(1)).alias("__n"), F.min(F.struct("seq", "pos")).alias("__first"))
        .where(F.col("__n") > 1).select("capture_id", "symbol", "t", "__first")
    )
    listed = small_side(universe.select("symbol", F.lit(True).alias("__listed")).distinct())
    calendar = F.broadcast(sessions.select("session", "market_open", "market_close"))
    joined = (
        ordered.join(firsts, ["capture_id", "symbol", "t"], "left").join(listed, "symbol", "left")
        .join(calendar, exchange_date(F.col("t")) == F.col("session"), "left")
    )
    absent = F.lit(False)
    for name in MINUTE_FIELDS:
        absent = absent | F.col("t_text" if name == "t" else f"{name}_wide").isNull()
    prices = F.col("o").isNull() | F.col("h").isNull() | F.col("l").isNull() | F.col("c").isNull()
    shape = ~(
        (F.col("l") > 0) & (F.col("l") <= F.least("o", "c")) & (F.greatest("o", "c") <= F.col("h"))
    )
    before = F.struct("__prev_symbol", "__prev_t")
    here = F.struct("symbol", "t")
    repeated = F.col("__first").isNotNull() & (F.struct("seq", "pos") > F.col("__first"))
    unordered = F.col("__prev_symbol").isNotNull() & (here <= before)
    inside = (
        F.col("session").isNotNull() & (F.col("session") == F.col("requested_day"))
        & (F.col("t") >= F.col("market_open")) & (F.col("t") < F.col("market_close"))
    )
    reason = first_reason([
        ("unexpected_symbol", F.col("__listed").isNull()),
        ("invalid_bar", absent),
        ("invalid_volume", ~yes(is_whole(F.col("v_wide")))),
        ("invalid_minute", F.col("t").isNull() | prices | shape | (F.col("v") < 0) | ~yes(is_whole_minute(F.col("t")))),
        ("duplicate_or_unordered_bar", repeated | unordered),
        ("outside_session", ~yes(inside)),
    ])
    return joined.withColumn("reject_reason", reason).drop(
        "__prev_symbol", "__prev_t", "__first", "__listed", "market_open", "market_close"
    )


def capture_verdicts(pages: DataFrame, sessions: DataFrame, universe: DataFrame) -> DataFrame:
    """(capture_id, seq, symbol, pos, t, reason): every bar page gives the verdicts of its minutes or one row with the fault of
    the page and no position, so nothing captured is lost without a word. A sound page without minutes gives one row without a
    reason."""
    bars = judged_pages(pages.where(F.col("path") == BARS_PATH))
    sound = sound_pages(bars)
    minutes = classify_minutes(minute_rows(sound), sessions, universe)
    whole = _rowless(bars, "bars").select(
        "capture_id", "seq", F.lit(None).cast("string").alias("symbol"), F.lit(None).cast("int").alias("pos"),
        F.lit(None).cast("timestamp").alias("t"), "reason")
    return minutes.select("capture_id", "seq", "symbol", "pos", "t", F.col("reject_reason").alias("reason")).unionAll(whole)


def judged_pages(pages: DataFrame) -> DataFrame:
    """``page_rejects``, written once: the strict reading is costly and every branch below needs its verdict."""
    return staged(page_rejects(pages), "judged-pages")


def sound_pages(judged: DataFrame) -> DataFrame:
    """The pages whose rows may be used."""
    return judged.where(F.col("reason").isNull()).drop("reason", "token")


def _rowless(judged: DataFrame, group: str) -> DataFrame:
    """Pages that stand for themselves among verdicts: refused ones, and sound ones without rows."""
    lists = F.from_json(F.get_json_object("body", f"$.{group}"), "map<string,array<string>>")
    rows = F.coalesce(F.size(F.flatten(F.map_values(lists))), F.lit(0))
    return judged.where(F.col("reason").isNotNull() | (rows <= 0))


def action_rows(pages: DataFrame) -> DataFrame:
    """One row per wire action with its kind, typed fields, page clock and ``revision_id``, the digest of its canonical form.

    Give sound pages; ``action_verdicts`` accounts for the others.
    """
    wire = pages.where(F.col("path") == ACTIONS_PATH).withColumns({
        "__body": F.from_json("body", ACTIONS_BODY),
        # The same lists as texts, for the fields no type of ours names; numbers keep their digits.
        "__raw": F.from_json(marked(F.col("body")), "corporate_actions map<string,array<string>>"),
    })
    kinds = wire.select("capture_id", "seq", "received_at", "__raw", F.explode_outer("__body.corporate_actions").alias("kind", "__rows"))
    rows = kinds.select(
        "capture_id", "seq", "received_at", "kind", F.try_element_at("__raw.corporate_actions", "kind").alias("__texts"),
        F.posexplode_outer("__rows").alias("pos", "__a"),
    )
    revision = sha256(canonical_marked(F.get("__texts", F.col("pos"))))
    return rows.where(F.col("pos").isNotNull()).select(
        "capture_id", "seq", "received_at", "kind", "pos", "__a.*", revision.alias("revision_id"))


def action_verdicts(pages: DataFrame, sessions: DataFrame, universe: DataFrame, start: Column, end: Column) -> DataFrame:
    """(capture_id, seq, pos, action_id, status): every action page gives the status of its actions or one row with the fault of
    the page and no position. A sound page without actions gives one row without a status."""
    judged = judged_pages(pages.where(F.col("path") == ACTIONS_PATH))
    rows = staged(action_rows(sound_pages(judged)), "action-rows")
    whole = _rowless(judged, "corporate_actions").select(
        "capture_id", "seq", F.lit(None).cast("int").alias("pos"), F.lit(None).cast("string").alias("action_id"), F.col("reason").alias("status"))
    return classify_actions(rows, sessions, universe, start, end).select("capture_id", "seq", "pos", "action_id", "status").unionAll(whole)


def classify_actions(
    actions: DataFrame, sessions: DataFrame, universe: DataFrame, start: Column, end: Column
) -> DataFrame:
    """Corporate actions with ``status``: a reject code, ``ignored`` (out of scope) or ``accepted``.

    The economic date decides the range, after the scan: the source can only filter by process date, which may lie
    outside the range while the economic date lies inside.
    """
    repeated = (
        actions.groupBy("capture_id", "id")
        .agg(F.count(F.lit(1)).alias("__n"), F.min(F.struct("seq", "kind", "pos")).alias("__first"))
        .where(F.col("__n") > 1).select("capture_id", "id", "__first")
    )
    # An empty text counts as absent, as any of the three dates may be missing.
    economic = F.coalesce(*[F.when(F.length(c) > 0, F.col(c)) for c in ("ex_date", "effective_date", "process_date")])
    dated = actions.withColumn("effective_session", session_date(economic)).withColumn(
        "__process", session_date(F.col("process_date"))
    )
    known = sessions.select(F.col("session").alias("effective_session"), F.col("market_open").alias("__open"))
    listed = small_side(universe.select("symbol", F.lit(True).alias("__listed")).distinct())
    joined = (
        dated.join(repeated, ["capture_id", "id"], "left").join(F.broadcast(known), "effective_session", "left")
        .join(listed, "symbol", "left")
    )
    supported = F.col("kind").isin(*SUPPORTED_KINDS)
    in_range = yes(F.col("effective_session").between(start, end))
    process_in_range = yes(F.col("__process").between(start, end))
    ratio = F.col("new_rate").cast("decimal(24,8)") / F.col("old_rate").cast("decimal(24,8)")
    split_ok = yes((F.col("old_rate") > 0) & (F.col("new_rate") > 0)) & yes(
        F.when(F.col("old_rate") > 0, is_whole(ratio) & (ratio >= 2))
    ) & F.col("due_bill_redemption_date").isNull()
    dividend_ok = (
        F.col("special").eqNullSafe(False) & F.col("foreign").eqNullSafe(False)
        & F.col("due_bill_on_date").isNull() & F.col("due_bill_off_date").isNull()
    )
    pay = session_date(F.col("payable_date"))
    cash = as_number(F.col("rate"))
    status = (
        F.when(F.col("id").isNull() | (F.length("id") == 0), "invalid_action")
        .when(F.col("__first").isNotNull() & (F.struct("seq", "kind", "pos") > F.col("__first")), "duplicate_action")
        .when(F.col("__process").isNull(), "invalid_action")
        .when(supported & F.col("ex_date").isNull(), "incomplete_actions")
        .when(F.col("effective_session").isNull(), "invalid_action")
        .when(~supported & (in_range | process_in_range), "unsupported_action")
        .when(~supported | ~in_range, "ignored")
        .when(F.col("__listed").isNull() | F.col("__open").isNull(), "action_scope")
        .when((F.col("kind") == "forward_splits") & ~split_ok, "unsupported_split")
        .when((F.col("kind") == "cash_dividends") & ~dividend_ok, "unsupported_dividend")
        .when((F.col("kind") == "cash_dividends") & ~yes((cash > 0) & (pay >= F.col("effective_session"))), "invalid_action")
        .otherwise("accepted")
    )
    is_split = F.col("kind") == "forward_splits"
    return joined.withColumn("status", status).select(
        "capture_id", "seq", "pos", F.col("id").alias("action_id"), "symbol", F.col("kind").alias("wire_kind"),
        F.when(is_split, "split").when(F.col("kind") == "cash_dividends", "cash_dividend").alias("kind"),
        "effective_session", F.col("__open").alias("available_at"), F.col("received_at").alias("first_ingested_at"),
        F.when(is_split & (F.col("old_rate") > 0), whole(ratio)).alias("split_ratio"),
        F.when(~is_split, cash).alias("cash_amount_usd"), F.when(~is_split, pay).alias("pay_date"), "revision_id", "status",
    )


def corporate_actions(classified: DataFrame) -> DataFrame:
    """Accepted actions with the columns of ``schemas.ACTIONS``, in canonical order within partitions of a symbol range."""
    accepted = classified.where(F.col("status") == "accepted")
    return accepted.select(
        F.lit(1).cast("tinyint").alias("schema_version"), "action_id", "symbol", "kind", "effective_session",
        "available_at", "first_ingested_at", "revision_id", "split_ratio", "cash_amount_usd", "pay_date",
    ).orderBy("symbol", "effective_session", "kind", "action_id")


def repeated_pages(pages: DataFrame, chain: list[str], fingerprint: Column) -> DataFrame:
    """Bodies or tokens that occur twice inside one query chain."""
    return (
        pages.select(*chain, fingerprint.alias("fingerprint"))
        .groupBy(*chain, "fingerprint").agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)
    )


def page_completeness(pages: DataFrame, expected: DataFrame, keys: list[str], compare: list[str]) -> DataFrame:
    """Recorded pages against expected ones, position by position: missing, extra or mismatched."""
    recorded = pages.select(*keys, F.struct(*compare).alias("__got"), F.lit(True).alias("__recorded"))
    wanted = expected.select(*keys, F.struct(*compare).alias("__want"), F.lit(True).alias("__expected"))
    joined = wanted.join(recorded, keys, "full_outer")
    status = (
        F.when(F.col("__recorded").isNull(), "incomplete_capture")
        .when(F.col("__expected").isNull(), "extra_capture_pages")
        .when(differs(F.col("__got"), F.col("__want")), "capture_request_mismatch")
        .otherwise("ok")
    )
    return joined.select(*keys, status.alias("status"))


def page_chain(pages: DataFrame, chain: list[str]) -> DataFrame:
    """Pages of paged queries against the tokens that lead from one to the next: (chain, seq, status).

    ``pages`` has the chain's columns, seq (from 0), requested_token and token, the latter null on the last page. Page n + 1 has
    to ask with the token page n returned. A page that a token promised and nobody recorded appears with its number.
    """
    promised = pages.select(*chain, (F.col("seq") + 1).alias("seq"), F.col("token").alias("__want"), F.lit(True).alias("__before"))
    copies = repeated_pages(pages.where(F.col("token").isNotNull()), chain, F.col("token")).select(
        *chain, F.col("fingerprint").alias("token"), F.lit(True).alias("__again"))
    recorded = pages.select(*chain, "seq", "requested_token", "token", F.lit(True).alias("__recorded")).join(copies, [*chain, "token"], "left")
    status = (
        F.when(F.col("__recorded").isNull(), "incomplete_capture")
        .when((F.col("seq") > 0) & F.col("__before").isNull(), "incomplete_capture")
        .when((F.col("seq") > 0) & F.col("__want").isNull(), "extra_capture_pages")
        .when(differs(F.col("requested_token"), F.col("__want")), "capture_request_mismatch")
        .when(yes(F.col("__again")), "repeated_token")
        .otherwise("ok")
    )
    joined = recorded.join(promised, [*chain, "seq"], "full_outer")
    return joined.where(F.col("__recorded").isNotNull() | F.col("__want").isNotNull()).select(*chain, "seq", status.alias("status"))


def cache_status(requests: DataFrame, receipts: DataFrame, captures: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Whether a request can be answered from its receipt: the receipt, capture and snapshot have to agree."""
    joined = (
        requests.join(receipts, "request_id", "left")
        .join(captures.select("capture_id", F.col("request_id").alias("__captured_for"), "corrupt"), "capture_id", "left")
        .join(snapshots.select("dataset_id", F.col("capture_id").alias("__built_from")), "dataset_id", "left")
    )
    status = (
        F.when(F.col("capture_id").isNull(), "cache_miss")
        .when(F.col("corrupt").isNull() | F.col("corrupt"), "capture_corrupt")
        .when(differs(F.col("__captured_for"), F.col("request_id"))
              | differs(F.col("__built_from"), F.col("capture_id")), "cache_mismatch")
        .otherwise("hit")
    )
    return joined.select("request_id", "capture_id", "dataset_id", status.alias("status"))


def latest_receipts(receipts: DataFrame) -> DataFrame:
    """The newest receipt per request."""
    rest = [c for c in receipts.columns if c != "request_id"]
    newest = receipts.groupBy("request_id").agg(
        F.max_by(F.struct(*rest), F.struct("completed_at", "capture_id")).alias("__r")
    )
    return newest.select("request_id", *[F.col(f"__r.{c}").alias(c) for c in rest])


def immutable_conflicts(rows: DataFrame, keys: list[str], content: Column) -> DataFrame:
    """Ids written more than once with different content; an immutable store must refuse those."""
    return content_versions(rows, keys, content)


def received_outside(pages: DataFrame, captures: DataFrame) -> DataFrame:
    """Pages received before their capture was requested or after it was finished."""
    return pages.join(captures.select("capture_id", "requested_at", "captured_at"), "capture_id").where(
        ~yes(F.col("received_at").between(F.col("requested_at"), F.col("captured_at")))
    )


def limitation_tags(origin: Column, feed: Column) -> Column:
    """Limitation tags of a dataset made from captured minutes."""
    # Tags every such dataset carries.
    base = F.array(*[F.lit(t) for t in (
        "unknown_revision_timing", "historical_availability_assumed", "historical_action_timing_assumed",
        "provider_action_completeness_unverified", "fixed_declared_universe", "regular_minutes_aggregation",
        "closing_boundary_auction_excluded",
    )])
    tagged = F.when(origin == "synthetic", F.array_append(base, F.lit("synthetic_data"))).otherwise(base)
    return F.when(feed == "iex", F.array_append(tagged, F.lit("single_exchange_iex"))).otherwise(tagged)

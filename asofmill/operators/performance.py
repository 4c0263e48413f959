"""What an account did: drawdowns and recoveries, holding periods and turnover, results under other costs and delays."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scans import Scan, running
from ..session import staged


def drawdowns(equity: DataFrame, keys: Sequence[str], slice_by: Column, session: str = "session", value: str = "equity") -> DataFrame:
    """One row per time under water: the peak before it, its lowest point, and the session that came back to the peak.

    ``equity`` has one row per key and session. A session is under water while its value is below the highest one before it; it
    recovers with the first value that reaches the peak again, and ``recovery_session`` is null where none does. Equal lowest values
    go by the first session.
    """
    rows = staged(equity.select(*keys, session, value), "equity")
    # The highest value so far and, of equal ones, its last session name the peak; every row that is not lower opens an episode.
    peaked = running(rows, keys, [session], {"__top": Scan("max", F.when(F.col(value).isNotNull(), F.struct(value, session)), True)}, slice_by)
    high = F.col("__top").isNull() | (F.col(value) >= F.col(f"__top.{value}"))
    own = F.struct(F.when(high, F.col(session)).otherwise(F.col(f"__top.{session}")).alias("episode"), F.lit(True).alias("own"))
    # A row that opens an episode is the recovery of the one before.
    before = F.struct(F.col(f"__top.{session}").alias("episode"), F.lit(False).alias("own"))
    parts = F.when(high & F.col("__top").isNotNull(), F.array(own, before)).otherwise(F.array(own))
    spread = peaked.select(*keys, session, value, F.explode(parts).alias("__part"))
    mine = F.col("__part.own")
    grouped = spread.groupBy(*keys, F.col("__part.episode").alias("__episode")).agg(
        F.min(F.when(mine, F.col(session))).alias("peak_session"), F.max(F.when(mine, F.col(value))).alias("peak"),
        F.min(F.when(mine, F.struct(value, session))).alias("__low"), (F.count(F.when(mine, 1)) - 1).alias("sessions_under"),
        F.min(F.when(~mine, F.col(session))).alias("recovery_session"))
    under = grouped.where("sessions_under > 0")
    trough = F.col(f"__low.{value}")
    depth = (F.col("peak").cast("double") - trough.cast("double")) / F.nullif(F.col("peak").cast("double"), F.lit(0.0))
    return under.select(*keys, "peak_session", "peak", F.col(f"__low.{session}").alias("trough_session"), trough.alias("trough"),
                        "recovery_session", "sessions_under", depth.alias("drawdown"))


def holding_periods(fills: DataFrame, keys: Sequence[str], order: Sequence[str], slice_by: Column, session: str = "session",
                    quantity: str = "quantity", price: str = "price") -> DataFrame:
    """Closed and open quantity, mean days held and traded value per key, the first unit bought being the first one sold.

    The k-th unit bought leaves with the k-th one sold. So the days of all closed units are those of the first units sold less
    those of the first units bought, up to the smaller of both totals; purchases and sales never have to be paired.
    """
    bought, sold = F.greatest(F.col(quantity), F.lit(0)), F.greatest(-F.col(quantity), F.lit(0))
    before = running(fills, keys, order, {"__b": Scan("sum", bought, True), "__s": Scan("sum", sold, True)}, slice_by)
    totals = fills.groupBy(*keys).agg(F.sum(bought).alias("__bought"), F.sum(sold).alias("__sold")).select(
        *[F.col(k).alias(f"__{k}") for k in keys], F.least("__bought", "__sold").alias("__closed"), (F.col("__bought") - F.col("__sold")).alias("open_quantity"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    day = F.datediff(F.col(session), F.lit("1970-01-01").cast("date")).cast("decimal(38,0)")

    def closed(amount: Column, earlier: str) -> Column:
        """How much of a fill lies within the closed quantity."""
        return F.greatest(F.lit(0), F.least(amount, F.col("__closed") - F.coalesce(earlier, F.lit(0)))).cast("decimal(20,0)")

    joined = before.join(totals, same)
    grouped = joined.groupBy(*keys).agg(
        F.max("__closed").alias("closed_quantity"), F.max("open_quantity").alias("open_quantity"), F.count(F.lit(1)).alias("trades"),
        F.sum(day * (closed(sold, "__s") - closed(bought, "__b"))).alias("__days"),
        F.sum(F.abs(F.col(quantity)) * F.col(price)).alias("traded_value"))
    mean = F.col("__days").cast("double") / F.nullif(F.col("closed_quantity"), F.lit(0)).cast("double")
    return grouped.withColumn("mean_days_held", mean).drop("__days")


class Scenario(NamedTuple):
    """A cost in basis points, a commission per fill, and by how many sessions a fill comes later."""

    name: str
    bps: int
    commission: str
    delay: int


def cost_sweep(fills: DataFrame, prices: DataFrame, keys: Sequence[str], scenarios: Sequence[Scenario]) -> DataFrame:
    """Cash per key under every scenario: (keys, scenario, cash, fills, unpriced).

    ``fills`` has symbol, place (the number of its session) and quantity; ``prices`` symbol, place and price, one row each. A fill
    whose delayed session has no price adds to ``unpriced`` and not to the cash. The scenarios are columns of one join and one
    aggregate, so their number changes neither rows nor shuffles nor the work per fill.
    """
    delays = sorted({s.delay for s in scenarios})
    at = prices.select("symbol", "price", F.explode(F.array(*[F.struct(F.lit(d).alias("d"), (F.col("place") - d).alias("place")) for d in delays])).alias("x"))
    known = at.groupBy("symbol", F.col("x.place").alias("place")).agg(*[F.max(F.when(F.col("x.d") == d, F.col("price"))).alias(f"__p{d}") for d in delays])
    priced = fills.join(known, ["symbol", "place"], "left")
    q = F.col("quantity").cast("decimal(20,0)")

    # Cash is linear in what is bought less sold, in what is traded and in the number of fills, so three exact sums per delay serve
    # all scenarios of that delay.
    sums = []
    for d in delays:
        price = F.col(f"__p{d}").cast("decimal(18,4)")
        sums += [F.sum((q * price).cast("decimal(28,4)")).alias(f"__net{d}"), F.sum((F.abs(q) * price).cast("decimal(28,4)")).alias(f"__traded{d}"),
                 F.count(price).alias(f"__priced{d}")]
    grouped = priced.groupBy(*keys).agg(F.count(F.lit(1)).alias("fills"), *sums)

    def cash(s: Scenario) -> Column:
        net, traded, count = (F.col(f"__{name}{s.delay}") for name in ("net", "traded", "priced"))
        # Ten-thousandths of ten-thousandths: a division would drop digits.
        cost = traded.cast("decimal(32,4)") * F.lit(f"{s.bps / 10_000:.4f}").cast("decimal(5,4)")
        fees = count.cast("decimal(20,0)") * F.lit(s.commission).cast("decimal(16,4)")
        # Narrow enough that the differences keep eight places.
        return (-net.cast("decimal(34,8)") - cost.cast("decimal(34,8)") - fees.cast("decimal(34,8)")).cast("decimal(38,8)")

    rows = F.array(*[F.struct(F.lit(s.name).alias("scenario"), cash(s).alias("cash"), (F.col("fills") - F.col(f"__priced{s.delay}")).alias("unpriced")) for s in scenarios])
    return grouped.select(*keys, "fills", F.inline(rows))

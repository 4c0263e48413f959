"""From target weights to whole shares that an account can pay for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scans import Scan, running


def share_deltas(targets: DataFrame, accounts: DataFrame, bps: int, commission: Column, max_shares: Column, slice_by: Column) -> DataFrame:
    """Orders per account and symbol: (account, symbol, wanted, quantity, cost, reason).

    ``targets`` has account, symbol, weight, price, held and pending (shares of open orders, signed); ``accounts`` has account, equity
    and cash. ``wanted`` is what leads from held and pending shares to the whole number of shares the weight buys. Sales are not
    limited by cash and bring none before they are done. Purchases, dearest first and then by symbol, are paid in that order with
    costs and commission: each gets the shares that are paid by what the whole of all before it leaves of the cash. So the first
    one that does not fit takes the rest and no account overspends. No order exceeds ``max_shares``. ``slice_by`` cuts the order of
    payment of an account with very many symbols.

    Reasons: ``invalid_price`` and ``no_account`` (nothing is ordered), ``covered`` (nothing to do), ``sell``, ``buy``, and for what was
    cut ``max_order`` or ``cash``; ``no_cash`` where nothing is left.
    """
    money = "decimal(38,8)"
    joined = targets.join(accounts.withColumnRenamed("account", "__account"), F.col("account") == F.col("__account"), "left")
    priced = F.coalesce(F.col("price") > 0, F.lit(False))
    aim = F.when(priced, F.expr("CAST(weight * equity AS DECIMAL(38,8)) DIV price"))
    wanted = F.when(priced & F.col("__account").isNotNull(), aim - F.coalesce("held", F.lit(0)) - F.coalesce("pending", F.lit(0))).cast("bigint")
    sized = joined.withColumn("wanted", wanted).withColumn("__most", F.least(F.abs("wanted"), max_shares).cast("bigint"))
    unit = (F.col("price") * (1 + F.lit(bps).cast("decimal(6,0)") / F.lit(10_000).cast("decimal(6,0)"))).cast("decimal(28,8)")
    costed = sized.withColumn("__unit", unit).withColumn(
        "__full", F.when(F.col("wanted") > 0, F.col("__most").cast("decimal(12,0)") * F.col("__unit") + commission).otherwise(F.lit(0)).cast(money))
    # The order of payment ascends, so the dearest comes first with the smallest of negative costs.
    placed = costed.withColumn("__rank", -F.col("__full"))
    paid = running(placed, ["account"], ["__rank", "symbol"], {"__before": Scan("sum", F.col("__full"), True)}, slice_by)
    left = F.greatest(F.lit(0), F.col("cash") - F.coalesce("__before", F.lit(0)) - commission)
    paid = paid.withColumn("__left", left.cast(money))
    affordable = F.greatest(F.lit(0), F.least(F.col("__most"), F.when(priced, F.expr("__left DIV __unit")))).cast("bigint")
    quantity = F.when(F.col("wanted") > 0, affordable).when(F.col("wanted") < 0, -F.col("__most")).otherwise(F.lit(0))
    reason = (
        F.when(F.col("__account").isNull(), "no_account").when(~priced, "invalid_price").when(F.col("wanted") == 0, "covered")
        .when((F.col("wanted") > 0) & (affordable == 0), "no_cash").when((F.col("wanted") > 0) & (affordable < F.col("__most")), "cash")
        .when(F.abs("wanted") > F.col("__most"), "max_order").when(F.col("wanted") < 0, "sell").otherwise("buy")
    )
    cost = F.when((F.col("wanted") > 0) & (affordable > 0), affordable.cast("decimal(12,0)") * F.col("__unit") + commission).otherwise(F.lit(0)).cast(money)
    return paid.select("account", "symbol", "wanted", quantity.cast("bigint").alias("quantity"), cost.alias("cost"), reason.alias("reason"))

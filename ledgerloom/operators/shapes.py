"""Shapes of transactions: which transfers make a swap, a liquidity action or a stake.

Input rows are transfers ``tx, asset, direction (IN/OUT), quantity``; one plan aggregates
by transaction, direction and asset and then by transaction.  Amounts given as text, such as
raw integers of up to 78 digits, are summed exactly and stay text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import wide
from ..sources.staging import met, placed


def _sides(transfers: DataFrame) -> DataFrame:
    """Per transaction the assets that came in and went out, sorted, with their sums."""
    by, amount = ["tx", "direction", "asset"], F.col("quantity")
    text = transfers.schema["quantity"].dataType.typeName() == "string"
    sums = wide.summed(transfers.select(*by, "quantity"), by, {"total": amount}).withColumnRenamed("total", "quantity") if text else transfers.groupBy(*by).agg(F.sum(amount).alias("quantity"))
    leg = F.struct("asset", "quantity")
    side = lambda d: F.array_sort(F.collect_list(F.when(F.col("direction") == d, leg)))
    return sums.groupBy("tx").agg(side("OUT").alias("out"), side("IN").alias("in"))


def swap_shape(transfers: DataFrame) -> DataFrame:
    """``tx, sold_asset, sold, bought_asset, bought, reason``: one asset out, one other in."""
    n_out, n_in = F.size("out"), F.size("in")
    reason = (
        F.when((n_out == 0) | (n_in == 0), "one-sided").when((n_out > 1) | (n_in > 1), "ambiguous-assets").when(F.col("out")[0]["asset"] == F.col("in")[0]["asset"], "same-asset")
    )
    got = _sides(transfers).withColumn("reason", reason)
    ok = F.col("reason").isNull()
    pick = lambda side, field: F.when(ok, F.try_element_at(side, F.lit(1))[field])
    return got.select("tx", pick("out", "asset").alias("sold_asset"), pick("out", "quantity").alias("sold"), pick("in", "asset").alias("bought_asset"), pick("in", "quantity").alias("bought"), "reason")


def lp_shape(transfers: DataFrame) -> DataFrame:
    """``tx, kind, lp_asset, asset0, asset1, reason, lp, amount0, amount1``: two out and one in add, one out and two in remove."""
    n_out, n_in = F.size("out"), F.size("in")
    overlap = F.arrays_overlap(F.transform("out", lambda x: x["asset"]), F.transform("in", lambda x: x["asset"]))
    kind = F.when((n_out == 2) & (n_in == 1), "LP_ADD").when((n_out == 1) & (n_in == 2), "LP_REMOVE")
    got = _sides(transfers).select("tx", "out", "in", F.when(~overlap, kind).alias("kind"), F.when(kind.isNull(), "ambiguous-assets").when(overlap, "overlapping-assets").alias("reason"))
    one = F.when(F.col("kind") == "LP_ADD", F.col("in")).when(F.col("kind") == "LP_REMOVE", F.col("out"))
    pair = F.when(F.col("kind") == "LP_ADD", F.col("out")).when(F.col("kind") == "LP_REMOVE", F.col("in"))
    at = lambda side, k: F.try_element_at(side, F.lit(k))["asset"]
    amount = lambda side, k: F.try_element_at(side, F.lit(k))["quantity"]
    amounts = [amount(one, 1).alias("lp"), amount(pair, 1).alias("amount0"), amount(pair, 2).alias("amount1")]
    return got.select("tx", "kind", at(one, 1).alias("lp_asset"), at(pair, 1).alias("asset0"), at(pair, 2).alias("asset1"), "reason", *amounts)


def stake_shape(transfers: DataFrame) -> DataFrame:
    """``tx, kind``: a single transfer out starts a stake, a single one in ends it (rows, not assets)."""
    n = transfers.groupBy("tx").agg(F.count_if(F.col("direction") == "OUT").alias("n_out"), F.count_if(F.col("direction") == "IN").alias("n_in"))
    kind = F.when((F.col("n_out") == 1) & (F.col("n_in") == 0), "STAKE_START").when((F.col("n_out") == 0) & (F.col("n_in") == 1), "STAKE_END")
    return n.select("tx", "n_out", "n_in", kind.alias("kind"))


def inline_protocol(transfers: DataFrame) -> DataFrame:
    """Transactions whose transfers look like a swap or liquidity action by their distinct assets."""
    side = lambda d: F.count_distinct(F.when(F.col("direction") == d, F.col("asset")))
    n = transfers.groupBy("tx").agg(side("OUT").alias("n_out"), side("IN").alias("n_in"), F.min(F.when(F.col("direction") == "OUT", F.col("asset"))).alias("a"), F.min(F.when(F.col("direction") == "IN", F.col("asset"))).alias("b"))
    swap = (F.col("n_out") == 1) & (F.col("n_in") == 1) & (F.col("a") != F.col("b"))
    lp = ((F.col("n_out") == 2) & (F.col("n_in") == 1)) | ((F.col("n_out") == 1) & (F.col("n_in") == 2))
    return n.where(swap | lp).select("tx", F.when(swap, "SWAP").otherwise("LP").alias("protocol"))


def inferred_protocols(transfers: DataFrame, transactions: DataFrame, staking_contract: str, by: tuple[str, ...] = ("tx",)) -> DataFrame:
    """``tx`` of transactions that transfers alone show to be a protocol's; ``by`` judges those of each chain and wallet by themselves.

    ``transfers``: ``tx, asset, token_address, from_address, to_address``; ``transactions``:
    ``tx, from_address, to_address``.  What goes out is what the transaction's sender sends,
    what comes in is what its receiver gets, whatever the wallet; hashes and addresses are
    compared lower-cased.  A call of the staking contract that moves its token counts too.
    Transfers without their transaction have no direction and make none.
    """
    on = [c for c in by if c != "wallet"]
    stay = placed(transfers) and placed(transfers) == placed(transactions)
    named = [F.lower("tx").alias("tx") if c == "tx" and not stay else F.col(c) for c in by]
    own = transactions.select(*(c for c, n in zip(named, by, strict=True) if n in on), F.lower("from_address").alias("sender"), F.lower("to_address").alias("receiver"))
    moved = met(transfers.select(*named, "asset", F.lower("token_address").alias("token"), F.lower("from_address").alias("giver"), F.lower("to_address").alias("taker")), own, on)
    side = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("asset"))))  # noqa: E731  sets of one transaction
    contract = staking_contract.lower()
    got = moved.groupBy(*by).agg(
        side(F.col("giver") == F.col("sender")).alias("out"), side(F.col("taker") == F.col("receiver")).alias("in"),
        F.bool_or((F.col("receiver") == contract) & (F.col("token") == contract)).alias("staked"),
    )
    n_out, n_in = F.size("out"), F.size("in")
    pair = ((n_out == 2) & (n_in == 1)) | ((n_out == 1) & (n_in == 2))
    swap = (n_out == 1) & (n_in == 1) & (F.try_element_at("out", F.lit(1)) != F.try_element_at("in", F.lit(1)))
    return got.where(F.coalesce("staked", F.lit(False)) | pair | swap).select(*by)

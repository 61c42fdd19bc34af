"""Positions from ledger entries: balances, liquidity and stakes, all wallets at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import wide

#: What a leg does to a balance.
SIGNS = {"IN": 1, "OUT": -1}


def sign(of: dict[str, int], column: str = "direction") -> Column:
    """1, -1 or 0 by the value of a column; null stays null."""
    out = F.when(F.col(column).isNull(), F.lit(None).cast("int"))
    for value, s in of.items():
        out = out.when(F.col(column) == value, s)
    return out.otherwise(0)


def token_balances(entries: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``wallet, asset, balance, warning``: IN less OUT, fees too, INTERNAL not; zeros go, negatives stay with a warning.

    Quantities are text, decimals, integers or doubles; balances are exact, of up to 90
    digits before the point, as text.
    """
    by = by or ["wallet", "asset"]
    sums = wide.summed(entries, by, {"balance": (F.col("quantity"), sign(SIGNS))}).where("balance != '0'")
    return sums.withColumn("warning", F.when(F.col("balance").startswith("-"), F.concat_ws(":", F.lit("negative-token-balance"), "asset", "balance")))


def _liquidity_groups(entries: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Each action's LP leg (that of an addition, else of a removal), its sum, and the other legs by asset."""
    lp_in, lp_out = F.col("entry_type") == "LP_ADD_IN", F.col("entry_type") == "LP_REMOVE_OUT"
    kind = F.when(F.col("entry_type").isin("LP_ADD_OUT", "LP_REMOVE_IN"), -sign(SIGNS))
    rows = entries.where(F.col("entry_type").startswith("LP_")).withColumn("_kind", kind)
    rows = rows.withColumn("_text", wide.expr(wide.text("quantity", entries.schema["quantity"].dataType, "_kind")))
    other = F.when(F.col("_kind").isNotNull(), F.struct("asset", F.col("_text").alias("quantity")))
    return wide.summed(
        rows, ["wallet", group],
        {"lp": (F.when(lp_in | lp_out, F.col("quantity")), sign(SIGNS))},
        F.coalesce(F.min(F.when(lp_in, F.col("asset"))), F.min(F.when(lp_out, F.col("asset")))).alias("lp_asset"),
        F.array_sort(F.collect_list(other)).alias("legs"),  # of one action
        F.min(F.struct(*order)).alias("first"),
    )


def liquidity_positions(entries: DataFrame, group: str = "tx", order: list[str] | None = None) -> DataFrame:
    """Two levels: each action's legs pivot to one LP leg and two others by asset, then exact sums by LP asset, as text.

    The first action of an LP asset, by the columns of ``order`` (such as time and id; the
    group alone if none are given), names its two others.
    """
    ok = _liquidity_groups(entries, group, order or [group]).where(F.col("lp_asset").isNotNull() & (F.size("legs") == 2))
    legs = [F.col("legs")[k] for k in (0, 1)]
    got = wide.summed(ok, ["wallet", "lp_asset"], {"amount": F.col("lp"), **{f"amount{k}": leg["quantity"] for k, leg in enumerate(legs)}}, *(F.min_by(leg["asset"], "first").alias(f"asset{k}") for k, leg in enumerate(legs)))
    got = got.withColumnRenamed("amount", "lp")
    return got.where("lp != '0' or amount0 != '0' or amount1 != '0'").select("wallet", "lp_asset", "lp", "asset0", "asset1", "amount0", "amount1")


def liquidity_warnings(entries: DataFrame, group: str = "tx") -> DataFrame:
    """``wallet, tx, warning`` of the actions that no position holds: without an LP leg, or without just two others."""
    ambiguous = F.concat(F.lit("lp-position-ambiguous-underlyings:"), F.size("legs").cast("string"))
    warning = F.when(F.col("lp_asset").isNull(), "lp-position-missing-lp-leg").when(F.size("legs") != 2, ambiguous)
    return _liquidity_groups(entries, group, [group]).select("wallet", group, warning.alias("warning")).where("warning is not null")


def stake_warnings(entries: DataFrame) -> DataFrame:
    """``wallet, tx, warning`` of staking entries that name no stake."""
    rows = entries.where(F.col("entry_type").startswith("STAKE_") & F.col("stake").isNull())
    return rows.select("wallet", "tx", F.concat_ws(":", F.lit("stake-key-missing"), "entry_type").alias("warning"))


def stake_positions(entries: DataFrame) -> DataFrame:
    """Exact sums by stake and kind of leg, as text; without a leg of a kind its sum stays null, as unknown is not zero."""
    kinds = {"principal": "STAKE_PRINCIPAL_LOCKED", "returned": "STAKE_PRINCIPAL_RETURNED", "yield_received": "STAKE_YIELD_RECEIVED", "penalty": "STAKE_PENALTY", "unallocated": "STAKE_RETURN_UNALLOCATED"}
    seen = lambda kind: F.bool_or(F.col("entry_type") == kind)
    amounts = {name: F.when(F.col("entry_type") == kind, F.col("quantity")) for name, kind in kinds.items()}
    status = F.when(seen("STAKE_END"), "ENDED").when(seen("STAKE_START"), "ACTIVE").otherwise("UNKNOWN")
    got = wide.summed(entries.where("stake is not null"), ["wallet", "stake"], amounts, status.alias("status"))
    return got.withColumn("principal", F.coalesce("principal", F.lit("0")))

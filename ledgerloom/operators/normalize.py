"""From raw facts to ledger drafts: each row becomes none to six legs, by exploding structs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import stake_split


def _leg(kind: str, direction: str, asset, quantity, when: Column | None = None) -> Column:
    leg = F.struct(F.lit(kind).alias("entry_type"), F.lit(direction).alias("direction"), asset.alias("asset"), quantity.cast("decimal(38,18)").alias("quantity"))
    return leg if when is None else F.when(when, leg)


def _exploded(rows: DataFrame, keep: list[str], legs: list[Column]) -> DataFrame:
    legs = F.filter(F.array(*legs), lambda x: x.isNotNull())
    return rows.select(*keep, F.explode(legs).alias("leg")).select(*keep, "leg.*")


def _fee() -> Column:
    return _leg("FEE", "OUT", F.lit("native"), F.col("fee"), F.col("fee") > 0)


def transfers(rows: DataFrame) -> DataFrame:
    """``tx, from, to`` tracked flags to RECEIVE, SEND or INTERNAL_TRANSFER; nothing if neither is tracked."""
    a, b = F.col("from_tracked"), F.col("to_tracked")
    legs = [
        _leg("INTERNAL_TRANSFER", "INTERNAL", F.col("asset"), F.col("quantity"), a & b),
        _leg("RECEIVE", "IN", F.col("asset"), F.col("quantity"), ~a & b),
        _leg("SEND", "OUT", F.col("asset"), F.col("quantity"), a & ~b),
    ]
    return _exploded(rows, ["tx"], legs)


def native(rows: DataFrame) -> DataFrame:
    """A value leg, unless zero or the transaction has tracked token transfers; and a fee if the sender is tracked."""
    value = (F.col("value") != 0) & ~F.col("has_transfers")
    legs = [
        _leg("SEND", "OUT", F.lit("native"), F.col("value"), value & F.col("from_tracked")),
        _leg("RECEIVE", "IN", F.lit("native"), F.col("value"), value & ~F.col("from_tracked") & F.col("to_tracked")),
        _leg("FEE", "OUT", F.lit("native"), F.col("fee"), F.col("from_tracked") & (F.col("fee") != 0)),
    ]
    return _exploded(rows, ["tx"], legs)


def swaps(rows: DataFrame) -> DataFrame:
    """``tx, sold_asset, sold, bought_asset, bought, fee`` to SWAP_OUT, SWAP_IN and a fee."""
    legs = [_leg("SWAP_OUT", "OUT", F.col("sold_asset"), F.col("sold")), _leg("SWAP_IN", "IN", F.col("bought_asset"), F.col("bought")), _fee()]
    return _exploded(rows, ["tx"], legs)


def liquidity(rows: DataFrame) -> DataFrame:
    """``tx, kind, lp_asset, asset0, asset1, lp, amount0, amount1, fee`` to the three legs of an addition or removal."""
    add = F.col("kind") == "LP_ADD"
    legs = [
        *(_leg("LP_ADD_OUT", "OUT", F.col(f"asset{k}"), F.col(f"amount{k}"), add) for k in (0, 1)),
        _leg("LP_ADD_IN", "IN", F.col("lp_asset"), F.col("lp"), add),
        _leg("LP_REMOVE_OUT", "OUT", F.col("lp_asset"), F.col("lp"), ~add),
        *(_leg("LP_REMOVE_IN", "IN", F.col(f"asset{k}"), F.col(f"amount{k}"), ~add) for k in (0, 1)),
        _fee(),
    ]
    return _exploded(rows, ["tx"], legs)


def stake_starts(rows: DataFrame) -> DataFrame:
    legs = [_leg("STAKE_START", "INTERNAL", F.col("asset"), F.lit(0)), _leg("STAKE_PRINCIPAL_LOCKED", "OUT", F.col("asset"), F.col("locked")), _fee()]
    return _exploded(rows, ["tx", "stake"], legs)


def stake_locks(rows: DataFrame) -> DataFrame:
    """``tx, stake, asset, locked`` to one STAKE_LOCK leg."""
    return _exploded(rows, ["tx", "stake"], [_leg("STAKE_LOCK", "OUT", F.col("asset"), F.col("locked"))])


def stake_ends(rows: DataFrame) -> DataFrame:
    """``tx, stake, asset, locked (null if unknown), total, fee``.

    With a known principal the total splits into principal, yield and penalty; without, it
    is returned unallocated.  A penalty is a leg of its own beside the principal, so a
    balance falls by it twice; that is how the ledger books it.
    """
    split = rows.select("*", *stake_split(F.col("locked"), F.col("total")))
    known = F.col("locked").isNotNull()
    asset = F.col("asset")
    legs = [
        _leg("STAKE_END", "INTERNAL", asset, F.lit(0)),
        _leg("STAKE_PRINCIPAL_RETURNED", "IN", asset, F.col("principal"), known & (F.col("principal") > 0)),
        _leg("STAKE_YIELD_RECEIVED", "IN", asset, F.col("yield_"), known & F.col("yield_").isNotNull()),
        _leg("STAKE_PENALTY", "OUT", asset, F.col("penalty"), known & F.col("penalty").isNotNull()),
        _leg("STAKE_RETURN_UNALLOCATED", "IN", asset, F.col("total"), ~known & (F.col("total") != 0)),
        _fee(),
    ]
    return _exploded(split, ["tx", "stake"], legs)

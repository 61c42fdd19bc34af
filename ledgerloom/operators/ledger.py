"""The ledger: who owns a fee, what evidence has consumed, which rows stay."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ACTION_PRIORITY


def action_rank(action: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*(F.lit(a) for a in ACTION_PRIORITY)), action), F.lit(0)) + F.when(action.isin(ACTION_PRIORITY), 0).otherwise(99)


def fee_owners(fees: DataFrame) -> DataFrame:
    """One fee per chain, wallet and transaction: that of the action of highest priority, then the first seen."""
    w = Window.partitionBy("chain_id", "wallet", "tx").orderBy(action_rank(F.col("action_type")), "seq")
    return fees.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")


def consumed(*evidence: DataFrame) -> DataFrame:
    """Transfers that recorded evidence of any family has consumed, once each."""
    used = [e.where("status = 'ACTIVE' and evidence = 'RECORDED'").select("transfer") for e in evidence]
    return reduce(DataFrame.union, used).distinct()


def suppress(transfers: DataFrame, used: DataFrame) -> DataFrame:
    """Transfers without those that evidence has consumed."""
    return transfers.join(used, "transfer", "left_anti")


def protocol_transactions(*families: DataFrame) -> DataFrame:
    """Distinct transactions of all protocol families."""
    return reduce(DataFrame.union, [f.select("tx") for f in families]).distinct()


def without_protocol(native: DataFrame, protocol: DataFrame) -> DataFrame:
    return native.join(protocol, "tx", "left_anti")


def removable_groups(entries: DataFrame, used: DataFrame) -> DataFrame:
    """Groups all of whose entries come from consumed transfers; others stay whole."""
    marked = entries.join(used.withColumn("hit", F.lit(True)), "transfer", "left")
    return marked.groupBy("group_id").agg(F.bool_and(F.coalesce("hit", F.lit(False))).alias("all")).where("all").select("group_id")


def mark_reorged(raw: DataFrame, low: int, high: int) -> DataFrame:
    return raw.withColumn("status", F.when(F.col("block_number").between(low, high), F.lit("REORGED")).otherwise(F.col("status")))


def scoped_delete(entries: DataFrame, scope: DataFrame) -> DataFrame:
    """The ledger without the transactions in scope; they are written anew."""
    return entries.join(scope.select("tx").distinct(), "tx", "left_anti")


def with_timestamps(raw: DataFrame, blocks: DataFrame) -> DataFrame:
    """Raw rows with their block's time; a row without its block is an error, not a null."""
    got = raw.join(blocks.select("block_number", F.lower("block_hash").alias("block_hash"), "timestamp"), ["block_number", "block_hash"], "left")
    missing = F.raise_error(F.concat(F.lit("no block "), F.col("block_number").cast("string"))).cast("timestamp")
    return got.withColumn("timestamp", F.when(F.col("timestamp").isNull(), missing).otherwise(F.col("timestamp")))

"""Reorganised blocks: what hangs on them, and the recomputation of just that.

Raw rows of a range are marked; their transactions name the wallets whose entries and
positions depend on them.  Entries of those transactions are normalised anew from the rows
that are still active, and positions of those wallets are computed anew.  All else is neither
read nor written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import stored
from .evidence import write_positions
from .merge import ENTRY, FOLDER, PARTITION, read_entries, replace, sliced


def marked(raw: DataFrame, chain: int, low: int, high: int) -> DataFrame:
    """Raw rows with those of the range on one chain ``REORGED``."""
    hit = (F.col("chain_id") == chain) & F.col("block_number").between(low, high)
    return raw.withColumn("status", F.when(hit, F.lit("REORGED")).otherwise(F.col("status")))


def changed(raw: DataFrame, chain: int, low: int, high: int) -> DataFrame:
    """``chain_id, tx`` of transactions that lose active rows to the range."""
    hit = (F.col("chain_id") == chain) & F.col("block_number").between(low, high) & (F.col("status") == "ACTIVE")
    return raw.where(hit).select("chain_id", "tx").distinct()


def cascade(
    spark: SparkSession, raw: DataFrame, ledger: str, positions: str, chain: int, low: int, high: int,
    normalise: Callable[[DataFrame], DataFrame], place: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """Bring ledger and positions in line with a reorganised range; ``chain_id, wallet`` of what was touched.

    ``raw`` is as it was before; ``normalise(raw)`` makes entries of active rows, ``place(entries)``
    positions of ``chain_id, wallet``.  Wallets are found from the entries of the changed
    transactions; of the ledger only those of their folders that hold such a transaction are
    rewritten.  A wallet that loses its last entry loses its folders' rows and its positions.
    """
    txs = stored(changed(raw, chain, low, high), "reorged")
    like = normalise(raw.limit(0))
    entries = read_entries(spark, ledger, like, ("slice",))
    held = stored(entries.where(F.col("chain_id") == chain).join(txs, ["chain_id", "tx"], "left_semi").select(*FOLDER).distinct(), "held")
    touched = held.select(*PARTITION).distinct()
    still = _of(marked(raw, chain, low, high).where("status = 'ACTIVE'"), txs)
    anew = stored(sliced(normalise(still).select(*ENTRY)).join(touched, PARTITION, "left_semi"), "anew")
    folders = stored(held.unionByName(anew.select(*FOLDER)).distinct(), "touched")
    mine = entries.join(_sent(folders), FOLDER, "left_semi").join(txs, ["chain_id", "tx"], "left_anti")
    replace(stored(mine.unionByName(anew), "entries").select(*ENTRY), ledger, folders)
    write_positions(place(read_entries(spark, ledger, like).join(_sent(touched), PARTITION, "left_semi")), positions, scope=touched)
    return touched


def _of(raw: DataFrame, txs: DataFrame) -> DataFrame:
    """Raw rows of transactions; few of them also become a filter that scans see, so that no other rows travel."""
    few = txs.select("tx").distinct().limit(1_001).collect()
    named = raw.where(F.col("tx").isin([r["tx"] for r in few])) if len(few) <= 1_000 else raw
    return named.join(txs, ["chain_id", "tx"], "left_semi")


def _sent(scope: DataFrame) -> DataFrame:
    """A scope, sent to all tasks if it is small."""
    return F.broadcast(scope) if scope.limit(100_001).count() <= 100_000 else scope

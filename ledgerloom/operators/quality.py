"""Checks on evidence: duplicates, backing logs, recomputed shapes and cursors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def duplicates(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("times")).where("times > 1")


def backing_logs(transfers: DataFrame, logs: DataFrame, key: list[str]) -> DataFrame:
    """Each transfer with the class of its backing logs: none, one or many."""
    n = logs.groupBy(*key).agg(F.count("*").alias("logs"))
    got = transfers.join(n, key, "left")
    return got.withColumn("backing", F.when(F.col("logs").isNull(), "none").when(F.col("logs") == 1, "one").otherwise("many")).drop("logs")


def provenance(stored: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Stored shapes against recomputed ones: same, changed, or no longer a shape."""
    a, b = stored.alias("a"), recomputed.alias("b")
    got = a.join(b, F.col("a.tx") == F.col("b.tx"), "left")
    same = F.col("a.kind").eqNullSafe(F.col("b.kind"))
    return got.select(F.col("a.tx").alias("tx"), F.when(F.col("b.kind").isNull(), "unresolved").when(same, "verified").otherwise("changed").alias("outcome"))


def merge_cursors(ranges: DataFrame, key: list[str]) -> DataFrame:
    """Overlapping or adjacent block ranges as one, gaps kept: islands by a running maximum."""
    w = Window.partitionBy(*key).orderBy("from_block", "to_block")
    before = F.max("to_block").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(before.isNull() | (F.col("from_block") > before + 1), 1).otherwise(0)
    marked = ranges.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*key, "island").agg(F.min("from_block").alias("from_block"), F.max("to_block").alias("to_block"), F.count("*").alias("merged")).drop("island")


def block_windows(spans: DataFrame, size: int) -> DataFrame:
    """Each ``[from_block, to_block]`` as windows of ``size`` blocks, the last one shorter."""
    starts = F.explode(F.sequence("from_block", "to_block", F.lit(size).cast("long"))).alias("low")
    return spans.select("*", starts).withColumn("high", F.least(F.col("low") + size - 1, F.col("to_block")))


def reorg_mismatch(old: DataFrame, new: DataFrame) -> DataFrame:
    """Blocks whose hash has changed."""
    b = new.select("block_number", F.col("block_hash").alias("new_hash"))
    return old.join(b, "block_number").where("block_hash != new_hash")

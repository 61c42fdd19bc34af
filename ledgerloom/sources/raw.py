"""Raw evidence on disk: one folder for each chain and bucket of blocks, sorted by block within its files.

A range of blocks names its buckets, so a scan lists and reads those folders alone; the order
within files lets Parquet skip what lies outside the range in the first and last of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Blocks of a bucket.
BUCKET = 100_000


def bucket_of(block: Column, size: int = BUCKET) -> Column:
    return F.floor(block / size).cast("long")


def write_raw(rows: DataFrame, path: str, size: int = BUCKET, mode: str = "append") -> None:
    """Add rows with ``chain_id, block_number``; tasks are balanced by bytes, so a busy bucket has several files."""
    key = ["chain_id", "block_bucket"]
    dealt = rows.withColumn("block_bucket", bucket_of(F.col("block_number"), size)).hint("rebalance", *key)
    dealt.sortWithinPartitions(*key, "block_number").write.mode(mode).partitionBy(*key).parquet(path)


def read_raw(spark: SparkSession, path: str, chain: int | None = None, low: int | None = None, high: int | None = None, size: int = BUCKET) -> DataFrame:
    """Rows of a chain and a range of blocks, both ends included; what is not given is not bounded."""
    rows = spark.read.parquet(path)
    if chain is not None:
        rows = rows.where(F.col("chain_id") == chain)
    if low is not None:
        rows = rows.where((F.col("block_bucket") >= low // size) & (F.col("block_number") >= low))
    if high is not None:
        rows = rows.where((F.col("block_bucket") <= high // size) & (F.col("block_number") <= high))
    return rows.drop("block_bucket")

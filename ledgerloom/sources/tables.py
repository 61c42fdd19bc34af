"""Reading the tables, and the ledger's view of the driver's trade tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import path_of, place

#: Bytes of a table's files for each task that its rows are dealt to: some 200,000 trade lines.
TASK_BYTES = 2_000_000
#: A table of that many bytes or more is not sent whole to every task: a broadcast table counts in each task's memory.
SENT_BYTES = 1_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(spark: SparkSession, sf_dir: str, name: str, finer: int = 1) -> int:
    """Tasks to deal a table's rows to, so that a task's share, or a part of it, stays the same as the table grows; at least as many as the session has."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-finer * _bytes(spark, sf_dir, name) // TASK_BYTES))


def _bytes(spark: SparkSession, sf_dir: str, name: str) -> int:
    path, files = path_of(spark, f"{sf_dir}/{name}.parquet")
    return files.getContentSummary(path).getLength()


def _met(spark: SparkSession, sf_dir: str, rows: DataFrame, key: str, name: str, other: DataFrame, other_key: str, n: int) -> DataFrame:
    """Rows with those of the table ``name`` by key: a small table goes to all tasks, a larger one is dealt by key to ``n`` tasks, as the rows are."""
    on = F.col(key) == F.col(other_key)
    if _bytes(spark, sf_dir, name) < SENT_BYTES:
        return rows.join(other, on)
    return rows.repartition(n, key).join(other.hint("merge"), on)


def legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trade lines as ledger legs: an order is a transaction, a nation a wallet, a brand an asset.

    Lines travel once, by order, to as many tasks as their table's size asks for (before that by
    part, if there are too many parts to send to every task); what is then grouped by transaction
    stays where it is, and no task's share grows with the table.
    """
    line = read(spark, sf_dir, "lineitem")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    part = read(spark, sf_dir, "part").select("p_partkey", "p_brand")
    n = tasks(spark, sf_dir, "lineitem")
    placed = _met(spark, sf_dir, orders, "o_custkey", "customer", customer, "c_custkey", tasks(spark, sf_dir, "orders"))
    dealt = _met(spark, sf_dir, line, "l_partkey", "part", part, "p_partkey", n).repartition(n, "l_orderkey")
    joined = dealt.join(placed, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(
        F.col("c_nationkey").alias("wallet"),
        F.col("p_brand").alias("asset"),
        F.col("l_orderkey").alias("tx"),
        F.when(F.col("l_returnflag") == "R", "OUT").otherwise("IN").alias("direction"),
        F.col("l_quantity").alias("quantity"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("value"),
        (F.col("l_extendedprice") * F.col("l_tax")).alias("fee"),
        F.col("l_shipdate").alias("occurred_at"),
        F.when(F.col("l_linestatus") == "F", "REORGED").otherwise("ACTIVE").alias("status"),
        F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("supplier"),
        F.col("l_extendedprice").alias("price"),
    )


#: The same in DuckDB's SQL.
LEGS = """legs AS (
  SELECT c_nationkey AS wallet, p_brand AS asset, l_orderkey AS tx, CASE WHEN l_returnflag = 'R' THEN 'OUT' ELSE 'IN' END AS direction,
         l_quantity AS quantity, l_extendedprice * (1 - l_discount) AS value, l_extendedprice * l_tax AS fee, l_shipdate AS occurred_at,
         CASE WHEN l_linestatus = 'F' THEN 'REORGED' ELSE 'ACTIVE' END AS status, l_linenumber AS line, l_partkey AS part, l_suppkey AS supplier, l_extendedprice AS price
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""

#: A total order of the legs.
ORDER = ["occurred_at", "tx", "line", "part", "supplier", "price", "quantity"]


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page views as price observations of their user's asset."""
    kinds = F.array(*(F.lit(k) for k in ("ONCHAIN_POOL", "ONCHAIN_ROUTE", "ORACLE", "MANUAL", "DEXSCREENER")))
    e = read(spark, sf_dir, "events").where("event_type = 'view'")
    return e.select(
        F.col("event_id").alias("price_id"),
        F.col("user_id").alias("asset"),
        F.col("value").alias("price"),
        F.element_at(kinds, (F.col("event_id") % 5 + 1).cast("int")).alias("source_type"),
        (F.col("event_id") % 100 / 100).alias("confidence"),
        F.col("ts").cast("timestamp").alias("observed_at"),
        F.lit(86400).alias("stale_after_seconds"),
    )


PRICES = """prices AS (
  SELECT event_id AS price_id, user_id AS asset, value AS price, ['ONCHAIN_POOL', 'ONCHAIN_ROUTE', 'ORACLE', 'MANUAL', 'DEXSCREENER'][event_id % 5 + 1] AS source_type,
         (event_id % 100) / 100 AS confidence, ts AS observed_at, 86400 AS stale FROM events WHERE event_type = 'view')"""


def raw_transfers(spark: SparkSession, sf_dir: str, dealt_to: int | None = None, placed_to: int | None = None) -> DataFrame:
    """Trade lines as raw token transfers: an order is a block of one transaction, customers and suppliers are addresses.

    Lines are dealt by order to ``dealt_to`` tasks, if given, before they meet their orders; or
    lines and orders are dealt by transaction to ``placed_to`` tasks and stay there as transfers.
    """
    line, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    tx = lambda key: F.concat(F.lit("0x"), F.lpad(F.col(key).cast("string"), 64, "0"))
    if placed_to:
        line = place(line.withColumn("tx", tx("l_orderkey")), placed_to).join(place(orders.withColumn("tx", tx("o_orderkey")), placed_to).hint("merge"), "tx")
    else:
        line = line.repartition(dealt_to, "l_orderkey") if dealt_to else line
        line = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("tx", tx("l_orderkey"))
    address = lambda key, base: F.concat(F.lit("0x"), F.lpad((F.col(key) + base).cast("string"), 40, "0"))
    out = F.col("l_returnflag") == "R"
    return line.select(
        F.lit(369).alias("chain_id"),
        "tx",
        F.col("l_orderkey").alias("block_number"),
        F.concat(F.lit("0xb"), F.lpad(F.col("l_orderkey").cast("string"), 63, "0")).alias("block_hash"),
        F.col("l_linenumber").alias("log_index"),
        F.when(out, address("o_custkey", 0)).otherwise(address("l_suppkey", 10**9)).alias("from_address"),
        F.when(out, address("l_suppkey", 10**9)).otherwise(address("o_custkey", 0)).alias("to_address"),
        F.concat(F.lit("chain:369:erc20:0x"), F.lpad((F.col("l_partkey") % 25).cast("string"), 40, "0")).alias("asset"),
        F.round(F.col("l_extendedprice") * 100).cast("long").cast("string").alias("amount_raw"),
        F.when(F.col("l_linestatus") == "F", "REORGED").otherwise("ACTIVE").alias("status"),
        F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("supplier"),
        F.col("l_shipdate").alias("occurred_at"),
    )


RAW = """raw AS (
  SELECT 369 AS chain_id, '0x' || lpad(l_orderkey::VARCHAR, 64, '0') AS tx, l_orderkey AS block_number, '0xb' || lpad(l_orderkey::VARCHAR, 63, '0') AS block_hash, l_linenumber AS log_index,
         '0x' || lpad((CASE WHEN l_returnflag = 'R' THEN o_custkey ELSE l_suppkey + 1000000000 END)::VARCHAR, 40, '0') AS from_address,
         '0x' || lpad((CASE WHEN l_returnflag = 'R' THEN l_suppkey + 1000000000 ELSE o_custkey END)::VARCHAR, 40, '0') AS to_address,
         'chain:369:erc20:0x' || lpad((l_partkey % 25)::VARCHAR, 40, '0') AS asset, round(l_extendedprice * 100)::BIGINT::VARCHAR AS amount_raw,
         CASE WHEN l_linestatus = 'F' THEN 'REORGED' ELSE 'ACTIVE' END AS status, l_partkey AS part, l_suppkey AS supplier, l_shipdate AS occurred_at
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

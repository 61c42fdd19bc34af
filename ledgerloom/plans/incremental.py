"""Queries that bring stored tables up to date, each with SQL that computes the whole at once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import wide
from ..operators import evidence, merge, positions, reorg
from ..sources.raw import read_raw, write_raw
from ..sources.staging import shared_dir, stored
from ..sources.tables import LEGS, RAW, legs, raw_transfers
from .queries import _KINDS, _actions, _query


def _drafts(rows: DataFrame) -> DataFrame:
    """Every leg as an entry of its action, with a fee draft of the same transaction."""
    fields = {"chain_id": F.lit(369), "group_id": F.concat_ws("-", "tx", "action_type"), "direction": F.lit("OUT"), "quantity": F.col("quantity").cast("string"), "tx": F.col("tx").cast("string")}
    leg = F.struct(F.concat_ws("/", "tx", "line", "part", "supplier", "price", "occurred_at").alias("id"), F.lit("LEG").alias("entry_type"), F.col("part").alias("transfer"))
    fee = F.struct(F.concat_ws("/", "wallet", "tx", F.lit("fee")).alias("id"), F.lit("FEE").alias("entry_type"), F.lit(None).cast("long").alias("transfer"))
    return rows.withColumns(fields).select("*", F.explode(F.array(leg, fee)).alias("draft")).select("*", "draft.*").select(*merge.ENTRY)


@_query(f"""WITH {LEGS}, a AS (SELECT *, {_KINDS}[part % 7 + 1] AS action FROM legs),
o AS (SELECT wallet, tx, arg_min(action, list_position(['HEX_STAKE_END', 'HEX_STAKE_START', 'HEX_STAKE_LOCK', 'SWAP', 'LP_ADD', 'LP_REMOVE', 'TRANSFER'], action)) AS owner FROM a GROUP BY ALL),
g AS (SELECT wallet, tx, bool_and(part % 3 = 0) AS used FROM a WHERE action = 'TRANSFER' GROUP BY ALL),
n AS (SELECT wallet, action AS action_type, count(*) AS entries, 0 AS fees FROM a LEFT JOIN g USING (wallet, tx) JOIN o USING (wallet, tx) WHERE NOT (action = 'TRANSFER' AND used AND owner <> 'TRANSFER') GROUP BY ALL
  UNION ALL SELECT wallet, owner, 0, count(*) FROM o GROUP BY ALL)
SELECT wallet, action_type, sum(entries)::BIGINT AS entries, sum(fees)::BIGINT AS fees FROM n GROUP BY ALL""")
def ledger_merge(spark, sf):
    """Plain transfers and swaps are stored first; the other families then take their fees, and evidence removes shadows."""
    rows = _actions(legs(spark, sf))
    early = F.col("action_type").isin("TRANSFER", "SWAP")
    batches = [stored(_drafts(rows.where(which)), "drafts") for which in (early, ~early)]
    used = batches[0].unionByName(batches[1]).where("transfer % 3 = 0").select("transfer")
    first = stored(merge.merged(batches[0].limit(0), batches[0]), "first-batch")
    got = merge.merged(first, batches[1], used)
    return got.groupBy("wallet", "action_type").agg(F.count_if(F.col("entry_type") != "FEE").alias("entries"), F.count_if(F.col("entry_type") == "FEE").alias("fees"))


def _normalise(raw: DataFrame) -> DataFrame:
    """Both ends of an active transfer as entries; a wallet is named by the end of its address."""
    ends = F.array(*(F.struct(F.concat(F.lit("w"), F.substring(F.col(f"{c}_address"), -2, 2)).alias("wallet"), F.lit(d).alias("direction")) for c, d in (("from", "OUT"), ("to", "IN"))))
    rows = raw.where("status = 'ACTIVE'").select("*", F.explode(ends).alias("end")).select("*", "end.*")
    rows = merge.dealt_to_folders(rows)  # ids are made after it, as they are long
    named = F.concat_ws("/", F.ltrim(F.col("tx"), F.lit("0x")), "log_index", "part", "supplier", "amount_raw", "occurred_at")
    return rows.select("chain_id", "wallet", "tx", F.concat_ws("/", named, "direction").alias("id"), named.alias("group_id"), F.lit("TRANSFER").alias("action_type"), F.when(F.col("direction") == "OUT", "SEND").otherwise("RECEIVE").alias("entry_type"), "direction", "asset", F.col("amount_raw").alias("quantity"), F.col("occurred_at").cast("timestamp").alias("occurred_at"), F.lit(None).cast("long").alias("transfer"), "slice")


def _place(entries: DataFrame) -> DataFrame:
    return positions.token_balances(entries, ["chain_id", "wallet", "asset"]).drop("warning")


@_query(f"""WITH {RAW}, e AS (SELECT 'w' || right(from_address, 2) AS wallet, asset, -(amount_raw::HUGEINT) AS q FROM raw WHERE block_number NOT BETWEEN 101 AND 110 UNION ALL SELECT 'w' || right(to_address, 2), asset, amount_raw::HUGEINT FROM raw WHERE block_number NOT BETWEEN 101 AND 110)
SELECT wallet, asset, sum(q)::VARCHAR AS balance FROM e GROUP BY ALL HAVING sum(q) <> 0""")
def reorged_positions(spark, sf):
    """Ledger and positions are stored whole; blocks 101 to 110 then go, and what hangs on them is computed anew."""
    raw = raw_transfers(spark, sf).withColumn("status", F.lit("ACTIVE"))
    at = f"{shared_dir(spark)}/reorg-{uuid.uuid4().hex}"
    merge.replace(_normalise(raw), f"{at}/ledger")
    evidence.write_positions(_place(merge.read_entries(spark, f"{at}/ledger", _normalise(raw))), f"{at}/positions")
    reorg.cascade(spark, raw, f"{at}/ledger", f"{at}/positions", 369, 101, 110, _normalise, _place)
    return evidence.read_positions(spark, f"{at}/positions").select("wallet", "asset", "balance")


@_query(f"WITH {RAW} SELECT block_number, asset, count(*) AS transfers, sum(amount_raw::HUGEINT)::VARCHAR AS amount FROM raw WHERE block_number BETWEEN 2500 AND 9100 GROUP BY ALL")
def bucketed_scan(spark, sf):
    """The raw table is written by chain and bucket, and a range of blocks is read from its buckets alone."""
    at = f"{shared_dir(spark)}/raw-{uuid.uuid4().hex}"
    write_raw(raw_transfers(spark, sf), at, 2_000)
    got = read_raw(spark, at, 369, 2500, 9100, 2_000)
    return wide.summed(got, ["block_number", "asset"], {"amount": "amount_raw"}, F.count("*").alias("transfers"))

"""Queries over raw evidence: scans, sinks, set operations and repairs, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import evidence as ev
from ..operators import ledger, normalize, quality
from ..sources.tables import LEGS, PRICES, RAW, legs, prices, raw_transfers, read, tasks
from .queries import _query

WALLET = "0x" + "7".rjust(40, "0")
SUPPLIER = "0x" + "1000000007".rjust(40, "0")


def _numbered(rows, *order):
    """The place of each row in the scan's order, as rows have none in a result."""
    from pyspark.sql import Window

    return rows.withColumn("seq", F.row_number().over(Window.orderBy(*order)).cast("long"))


@_query(f"""WITH {RAW} SELECT tx, log_index, asset, amount_raw, part, row_number() OVER (ORDER BY block_number, log_index, part, amount_raw) AS seq FROM raw
WHERE status = 'ACTIVE' AND block_number BETWEEN 100 AND 14000 AND (from_address = '{SUPPLIER}' OR to_address = '{SUPPLIER}')""")
def scan_wallet_transfers(spark, sf):
    rows = ev.wallet_transfers(raw_transfers(spark, sf), SUPPLIER.upper().replace("0X", "0x"), 100, 14000)
    return _numbered(rows, "block_number", "log_index", "part", "amount_raw").select("tx", "log_index", "asset", "amount_raw", "part", "seq")


_ORDERS = """o AS (SELECT o_orderkey AS id, o_orderkey AS block_number, o_orderkey % 7 AS tx_index, '0x' || lpad((o_custkey % 50)::VARCHAR, 40, '0') AS from_address, o_totalprice AS value,
  CASE o_orderstatus WHEN 'F' THEN 'REORGED' ELSE 'ACTIVE' END AS status, CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'RECORDED' ELSE 'VERIFIED_EMPTY' END AS evidence_status,
  ['SWAP', 'LP_ADD', 'HEX_STAKE_START', 'TRANSFER'][o_orderkey % 4 + 1] AS action_type FROM orders)"""


def _orders(spark, sf):
    kinds = F.array(*(F.lit(k) for k in ("SWAP", "LP_ADD", "HEX_STAKE_START", "TRANSFER")))
    o = F.col("o_orderkey")
    return read(spark, sf, "orders").select(
        o.alias("id"), o.alias("block_number"), (o % 7).alias("tx_index"), F.concat(F.lit("0x"), F.lpad((F.col("o_custkey") % 50).cast("string"), 40, "0")).alias("from_address"), F.col("o_totalprice").alias("value"),
        F.when(F.col("o_orderstatus") == "F", "REORGED").otherwise("ACTIVE").alias("status"), F.when(o % 3 == 1, "RECORDED").when(o % 3 == 2, "VERIFIED_EMPTY").alias("evidence_status"), kinds[(o % 4).cast("int")].alias("action_type"),
    )


@_query(f"WITH {_ORDERS} SELECT id, tx_index, value, row_number() OVER (ORDER BY block_number, tx_index) AS seq FROM o WHERE status = 'ACTIVE' AND block_number BETWEEN 50 AND 12000 AND from_address = '{WALLET}'")
def scan_wallet_transactions(spark, sf):
    return _numbered(ev.wallet_rows(_orders(spark, sf), WALLET, 50, 12000, "from_address", ["block_number", "tx_index"]), "block_number", "tx_index").select("id", "tx_index", "value", "seq")


@_query(f"WITH {_ORDERS} SELECT action_type, id, row_number() OVER (PARTITION BY action_type ORDER BY id) AS seq FROM o WHERE status = 'ACTIVE' AND block_number BETWEEN 50 AND 12000 AND from_address = '{WALLET}' AND action_type <> 'TRANSFER'")
def scan_wallet_actions(spark, sf):
    from pyspark.sql import Window

    rows = ev.wallet_rows(_orders(spark, sf).where("action_type != 'TRANSFER'"), WALLET, 50, 12000, "from_address", ["id"])
    return rows.select("action_type", "id", F.row_number().over(Window.partitionBy("action_type").orderBy("id")).cast("long").alias("seq"))


_LOGS = f"""logs AS (SELECT tx, log_index, block_number, status, part, supplier, CASE WHEN part % 10 = 0 THEN NULL WHEN part % 10 = 1 THEN '0xother' ELSE '{ev.TRANSFER_TOPIC}' END AS topic0,
  '0x' || repeat('0', 24) || substr(from_address, 3) AS topic1, '0x' || repeat('0', 24) || substr(to_address, 3) AS topic2 FROM raw)"""


def _logs(spark, sf):
    r = raw_transfers(spark, sf)
    topic = F.when(F.col("part") % 10 == 1, "0xother").when(F.col("part") % 10 > 1, ev.TRANSFER_TOPIC)
    return r.select("tx", "log_index", "block_number", "status", "part", "supplier", topic.alias("topic0"), ev.padded_topic(F.col("from_address")).alias("topic1"), ev.padded_topic(F.col("to_address")).alias("topic2"))


@_query(f"""WITH {RAW}, {_LOGS} SELECT tx, log_index, part FROM logs WHERE status = 'ACTIVE' AND block_number BETWEEN 1 AND 15000 AND topic0 = '{ev.TRANSFER_TOPIC}'
AND (topic1 LIKE '%{SUPPLIER[2:]}' OR topic2 LIKE '%{SUPPLIER[2:]}')""")
def scan_wallet_logs(spark, sf):
    return ev.wallet_logs(_logs(spark, sf), SUPPLIER, 1, 15000).select("tx", "log_index", "part")


@_query(f"""WITH {RAW}, {_LOGS} SELECT CASE WHEN topic0 IS NULL OR topic0 = '0xother' THEN 'not-a-transfer' WHEN topic1 NOT LIKE '%{SUPPLIER[2:]}' AND topic2 NOT LIKE '%{SUPPLIER[2:]}' THEN 'wallet-not-named' END AS reason,
count(*) AS logs FROM logs GROUP BY ALL""")
def transfer_log_filter(spark, sf):
    return ev.only_transfers(_logs(spark, sf), SUPPLIER).groupBy("reason").agg(F.count("*").alias("logs"))


@_query(f"WITH {_ORDERS} SELECT id, action_type FROM o WHERE id > 700 AND evidence_status IS NULL AND action_type = 'SWAP' ORDER BY id LIMIT 40")
def keyset_scan(spark, sf):
    return ev.without_evidence(_orders(spark, sf).where("action_type = 'SWAP'"), F.lit(700), 40).select("id", "action_type")


@_query(f"WITH {PRICES} SELECT price_id, price, row_number() OVER (ORDER BY observed_at DESC, price_id DESC) AS seq FROM prices WHERE asset = 7")
def price_series(spark, sf):
    from ..operators.pricing import series

    rows = series(prices(spark, sf).withColumns({"chain_id": F.lit(369), "quote": F.lit("fiat:usd"), "created_at": F.col("observed_at")}), 369, 7, "fiat:usd")
    return _numbered(rows, F.desc("observed_at"), F.desc("price_id")).select("price_id", "price", "seq")


@_query(f"""WITH {RAW} SELECT lower(asset) AS asset, count(*) AS rows FROM (SELECT *, row_number() OVER (PARTITION BY tx, log_index ORDER BY part, supplier, amount_raw) AS n FROM raw WHERE block_number % 2 = 1) x
WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM raw o WHERE o.block_number % 10 = 1 AND o.tx = x.tx AND o.log_index = x.log_index) GROUP BY ALL""")
def insert_absent(spark, sf):
    raw = raw_transfers(spark, sf)
    new = raw.where("block_number % 2 = 1").withColumn("asset", F.upper("asset"))
    return ev.insert_absent(raw.where("block_number % 10 = 1"), new, ["tx", "log_index"], ["part", "supplier", "amount_raw"], ["asset"]).groupBy("asset").agg(F.count("*").alias("rows"))


@_query(f"""WITH {RAW}, {_ORDERS}, e AS (SELECT block_number AS id, count(*) FILTER (WHERE part % 3 = 0) AS n FROM raw GROUP BY ALL)
SELECT action_type, CASE WHEN coalesce(n, 0) > 0 THEN 'RECORDED' ELSE 'VERIFIED_EMPTY' END AS evidence_status, count(*) AS actions, sum(coalesce(n, 0))::BIGINT AS edges FROM o LEFT JOIN e USING (id) GROUP BY ALL""")
def evidence_rollup(spark, sf):
    plans = raw_transfers(spark, sf).where("part % 3 = 0").select(F.col("block_number").alias("id"))
    actions = _orders(spark, sf).select("id", F.col("id").alias("action"), "action_type")
    edges = ev.persisted_edges(plans, actions, ["id"])
    got = ev.evidence_status(actions, edges).join(actions, "action")
    return got.groupBy("action_type", "evidence_status").agg(F.count("*").alias("actions"), F.sum("edges").alias("edges"))


@_query("""WITH d AS (SELECT user_id AS asset, ts, event_id, value, 369 AS chain_id, 'chain' AS k, 'po_' || sha256('{"chain_id":369,"asset":' || user_id || ',"source_type":"ORACLE","observed_at":"' || strftime(ts, '%Y-%m-%d') || '"}') AS id FROM events),
l AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY event_id DESC) = 1)
SELECT id, event_id, value FROM l WHERE id NOT IN (SELECT id FROM d WHERE asset % 4 = 0)""")
def price_sink(spark, sf):
    e = read(spark, sf, "events")
    drafts = e.select(F.lit(369).alias("chain_id"), F.col("user_id").alias("asset"), F.lit("ORACLE").alias("source_type"), F.date_format("ts", "yyyy-MM-dd").alias("observed_at"), "event_id", "value")
    old = drafts.where("asset % 4 = 0").select(scalars.content_id("po_", "chain_id", "asset", "source_type", "observed_at").alias("id"))
    return ev.price_drafts(drafts, old, "event_id").select("id", "event_id", "value")


@_query("""WITH a AS (SELECT p_partkey AS token, p_brand AS symbol, CASE WHEN p_size % 5 > 0 THEN p_size END AS decimals FROM part WHERE p_partkey % 3 < 2),
b AS (SELECT p_partkey AS token, CASE WHEN p_partkey % 4 > 0 THEN p_type END AS symbol, CASE WHEN p_size % 2 = 0 THEN p_size + 1 END AS decimals FROM part WHERE p_partkey % 3 > 0)
SELECT coalesce(a.token, b.token) AS token, coalesce(b.symbol, a.symbol) AS symbol, coalesce(b.decimals, a.decimals) AS decimals,
CASE WHEN a.token IS NULL THEN 'created' WHEN b.token IS NULL THEN 'kept' ELSE 'updated' END AS state FROM a FULL JOIN b ON a.token = b.token""")
def metadata_upsert(spark, sf):
    p, k = read(spark, sf, "part"), F.col("p_partkey")
    old = p.where(k % 3 < 2).select(k.alias("token"), F.col("p_brand").alias("symbol"), F.when(F.col("p_size") % 5 > 0, F.col("p_size")).alias("decimals"))
    new = p.where(k % 3 > 0).select(k.alias("token"), F.when(k % 4 > 0, F.col("p_type")).alias("symbol"), F.when(F.col("p_size") % 2 == 0, F.col("p_size") + 1).alias("decimals"))
    return ev.upsert_metadata(old, new, "token", ["symbol", "decimals"])


_DAYS = """days AS (SELECT date_diff('day', DATE '1992-01-01', o_orderdate::DATE) AS day, count(*) AS orders, sum(o_custkey)::BIGINT AS keys FROM orders GROUP BY ALL)"""


def days(spark, sf):
    """Orders of each day as packed daily data: payout in the low 72 bits, shares above."""
    o = read(spark, sf, "orders")
    got = o.groupBy(F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01").cast("date")).alias("day")).agg(F.count("*").alias("orders"), F.sum("o_custkey").alias("keys"))
    wide = F.col("keys").cast("decimal(16,0)") * F.lit(str(2**72)).cast("decimal(22,0)")
    return got.select("day", F.floor(F.col("day") / 30).cast("long").alias("month"), "orders", "keys", (wide + F.col("orders")).cast("decimal(38,0)").alias("packed"))


@_query(f"""WITH {_DAYS}, p AS (SELECT day // 30 AS month, day, keys::HUGEINT * 4722366482869645213696 + orders AS packed FROM days)
SELECT month, '{{"schemaVersion":"v1","dailyData":[' || string_agg('"' || packed || '"', ',' ORDER BY day) || ']}}' AS payload FROM p GROUP BY ALL""")
def encoded_payloads(spark, sf):
    return ev.encoded_days(days(spark, sf), ["month"])


@_query(f"""WITH {_DAYS}, p AS (SELECT day // 30 AS month, '{{"schemaVersion":"v1","dailyData":[' || string_agg(CASE WHEN day % 97 = 5 THEN orders::VARCHAR ELSE '"' || orders || '"' END, ',' ORDER BY day) || ']}}' AS payload, bool_or(day % 97 = 5) AS bad FROM days GROUP BY ALL)
SELECT month AS observation, sha256(payload) AS payload_hash, CASE WHEN bad THEN 'rejected' WHEN month % 4 = 0 THEN 'found' ELSE 'created' END AS outcome FROM p""")
def observation_sink(spark, sf):
    text = F.when(F.col("day") % 97 == 5, F.col("orders").cast("string")).otherwise(F.concat(F.lit('"'), F.col("orders").cast("string"), F.lit('"')))
    items = F.transform(F.array_sort(F.collect_list(F.struct("day", text.alias("t")))), lambda x: x.t)
    got = days(spark, sf).groupBy("month").agg(F.concat(F.lit('{"schemaVersion":"v1","dailyData":['), F.array_join(items, ","), F.lit("]}")).alias("payload"))
    drafts = got.select(F.col("month").alias("observation"), F.lit(369).alias("chain_id"), (F.col("month") * 30).alias("from_day"), (F.col("month") * 30 + 29).alias("to_day"), "payload")
    old = drafts.where("observation % 4 = 0").withColumn("payload_hash", F.sha2("payload", 256))
    return ev.observations_to_store(drafts, old)


_SCOPED = f"WITH {LEGS}, e AS (SELECT *, CASE line % 3 WHEN 0 THEN 'SWAP' WHEN 1 THEN 'TRANSFER' ELSE 'LP_ADD' END AS action_type FROM legs)"


@_query(_SCOPED + """ SELECT 'transactions' AS scope, count(*) AS entries FROM e WHERE action_type IN ('SWAP', 'TRANSFER') AND tx % 11 = 0 UNION ALL
SELECT 'times', count(*) FROM e WHERE action_type IN ('SWAP', 'TRANSFER') AND occurred_at BETWEEN '1995-01-01' AND '1995-06-30' UNION ALL SELECT 'all', count(*) FROM e WHERE action_type IN ('SWAP', 'TRANSFER')""")
def scoped_delete(spark, sf):
    kind = F.when(F.col("line") % 3 == 0, "SWAP").when(F.col("line") % 3 == 1, "TRANSFER").otherwise("LP_ADD")
    e = legs(spark, sf).withColumn("action_type", kind)
    kinds, at = ["SWAP", "TRANSFER"], lambda t: F.lit(t).cast("timestamp_ntz")
    none = e.limit(0)
    found = [("transactions", ev.scoped(e, kinds, e.where("tx % 11 = 0"))), ("times", ev.scoped(e, kinds, none, at("1995-01-01"), at("1995-06-30"))), ("all", ev.scoped(e, kinds, none))]
    out = None
    for name, rows in found:
        one = rows.agg(F.count("*").alias("entries")).select(F.lit(name).alias("scope"), "entries")
        out = one if out is None else out.unionByName(one)
    return out


@_query(f"WITH {RAW} SELECT CASE WHEN block_number BETWEEN 300 AND 900 THEN 'REORGED' ELSE status END AS status, count(*) AS rows FROM raw GROUP BY ALL")
def reorg_marker(spark, sf):
    return ledger.mark_reorged(raw_transfers(spark, sf), 300, 900).groupBy("status").agg(F.count("*").alias("rows"))


@_query("""WITH b AS (SELECT lower('0xAB' || c_custkey) AS address, max('seen ' || c_nationkey) AS label FROM customer WHERE c_custkey % 2 = 0 GROUP BY ALL), a AS (SELECT '0xab' || c_custkey AS address, 'old' AS label FROM customer WHERE c_custkey % 3 = 0)
SELECT coalesce(a.address, b.address) AS address, coalesce(b.label, a.label) AS label, CASE WHEN a.address IS NULL THEN 'created' WHEN b.address IS NULL THEN 'kept' ELSE 'updated' END AS state FROM a FULL JOIN b ON a.address = b.address""")
def wallet_import(spark, sf):
    c, k = read(spark, sf, "customer"), F.col("c_custkey")
    old = c.where(k % 3 == 0).select(F.concat(F.lit("0xab"), k.cast("string")).alias("address"), F.lit("old").alias("label"))
    new = c.where(k % 2 == 0).select(F.lower(F.concat(F.lit("0xAB"), k.cast("string"))).alias("address"), F.concat(F.lit("seen "), F.col("c_nationkey").cast("string")).alias("label"))
    return ev.upsert_metadata(old, new, "address", ["label"])


@_query("""SELECT c_custkey AS wallet, c_nationkey % 5 = 0 OR EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c_custkey AND o_orderstatus = 'P') AS blocked FROM customer""")
def conflicting_runs(spark, sf):
    from ..operators.reports import conflicting

    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("wallet"), F.lit(369).alias("chain_id"), (F.col("c_nationkey") % 5 == 0).alias("everywhere"))
    runs = read(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("wallet"), F.lit(369).alias("chain_id"), F.lit("SYNC").alias("kind"), F.lit("RUNNING").alias("state"))
    return conflicting(c.drop("everywhere"), runs).join(c.select("wallet", "everywhere"), "wallet").select("wallet", (F.col("blocked") | F.col("everywhere")).alias("blocked"))


@_query(f"""WITH {RAW}, {_LOGS} SELECT topic0, count(*) AS transfers FROM logs WHERE topic0 IS NULL OR topic0 <> '{ev.TRANSFER_TOPIC}' GROUP BY ALL""")
def not_transfer_logs(spark, sf):
    key = ["tx", "log_index", "part", "supplier"]
    n = _logs(spark, sf).select(*key, "topic0").distinct()
    return ev.not_transfer_logs(raw_transfers(spark, sf), n, key).groupBy("topic0").agg(F.count("*").alias("transfers"))


@_query(f"""WITH {RAW}, {_LOGS}, n AS (SELECT tx, log_index, count(*) AS logs, count(*) FILTER (WHERE topic0 IS DISTINCT FROM '{ev.TRANSFER_TOPIC}') AS others FROM logs WHERE status = 'ACTIVE' AND supplier % 9 > 0 GROUP BY ALL)
SELECT CASE WHEN logs IS NULL THEN 'missing-log' WHEN logs > 1 THEN 'ambiguous-logs' WHEN others = 1 THEN 'fabricated' ELSE 'backed' END AS outcome, count(*) AS transfers
FROM raw LEFT JOIN n USING (tx, log_index) WHERE raw.status = 'ACTIVE' GROUP BY ALL""")
def fabricated_transfers(spark, sf):
    found = ev.fabricated(raw_transfers(spark, sf), _logs(spark, sf).where("supplier % 9 > 0"), ["tx", "log_index"])
    return found.groupBy("outcome").agg(F.count("*").alias("transfers"))


@_query(f"""WITH {RAW}, t AS (SELECT block_number, count(*) AS n FROM raw GROUP BY ALL), p AS (SELECT DISTINCT block_number FROM raw WHERE part % 7 = 0),
s AS (SELECT o_orderkey AS block_number, 0 AS kind, n IS NOT NULL AS has_transfers, FALSE AS shadow FROM orders LEFT JOIN t ON o_orderkey = block_number WHERE o_orderkey NOT IN (SELECT block_number FROM p)
  UNION ALL SELECT block_number, 1, TRUE, part % 5 = 0 FROM raw)
SELECT kind, has_transfers, shadow, count(*) AS snapshots FROM s GROUP BY ALL""")
def native_snapshots(spark, sf):
    share = tasks(spark, sf, "lineitem")
    raw = raw_transfers(spark, sf, share).withColumn("transfer", F.struct("part", "tx", "log_index", "supplier", "amount_raw"))
    txs = read(spark, sf, "orders").select(F.concat(F.lit("0x"), F.lpad(F.col("o_orderkey").cast("string"), 64, "0")).alias("tx"), F.col("o_orderkey").alias("block_number"), F.lit(0).alias("tx_index"))
    used = raw.where("part % 5 = 0").select("transfer")
    got = ev.native_snapshots(txs, raw.select("tx", "block_number", "log_index", "transfer"), raw.where("part % 7 = 0").select("tx"), used, share)
    return got.groupBy("kind", "has_transfers", "shadow").agg(F.count("*").alias("snapshots"))


@_query(f"""WITH {RAW}, a AS (SELECT tx, log_index, block_hash FROM raw WHERE part % 2 = 0 UNION SELECT tx, log_index, block_hash FROM raw WHERE part % 3 = 0), s AS (SELECT DISTINCT tx, log_index FROM raw WHERE part % 6 = 0)
SELECT (SELECT count(*) FROM a) AS logs, (SELECT count(*) FROM (SELECT DISTINCT tx, log_index FROM a EXCEPT SELECT * FROM s)) AS lost""")
def log_sets(spark, sf):
    raw = raw_transfers(spark, sf).select("tx", "log_index", "block_hash", "part")
    both = ev.union_logs(raw.where("part % 2 = 0").drop("part"), raw.where("part % 3 = 0").drop("part"))
    stored = raw.where("part % 6 = 0").select("tx", "log_index").distinct()
    lost = ev.lost_identities(both.select("tx", "log_index").distinct(), stored, ["tx", "log_index"])
    return both.agg(F.count("*").alias("logs")).crossJoin(lost.agg(F.count("*").alias("lost")))  # one row each


@_query("""WITH w AS (SELECT o_custkey % 40 AS wallet, o_orderstatus AS code, o_orderpriority AS message FROM orders UNION SELECT c_custkey % 40, 'N', c_mktsegment FROM customer)
SELECT wallet, count(*) AS warnings, least(count(*), 5) + CASE WHEN count(*) > 5 THEN 1 ELSE 0 END AS shown, CASE WHEN count(*) > 5 THEN 'warnings-truncated:' || (count(*) - 5) END AS marker FROM w GROUP BY ALL""")
def merged_warnings(spark, sf):
    a = read(spark, sf, "orders").select((F.col("o_custkey") % 40).alias("wallet"), F.col("o_orderstatus").alias("code"), F.col("o_orderpriority").alias("message"))
    b = read(spark, sf, "customer").select((F.col("c_custkey") % 40).alias("wallet"), F.lit("N").alias("code"), F.col("c_mktsegment").alias("message"))
    got = ev.merge_warnings(a, b).groupBy("wallet").agg(F.array_sort(F.collect_list(F.concat_ws(":", "code", "message"))).alias("all"))
    cut = ev.capped_warnings(F.col("all"), 5)
    last = F.element_at(cut, -1)
    return got.select("wallet", F.size("all").cast("long").alias("warnings"), F.size(cut).cast("long").alias("shown"), F.when(last.startswith("warnings-truncated:"), last).alias("marker"))


@_query(f"""WITH {LEGS} SELECT DISTINCT tx AS group_id FROM legs WHERE direction = 'OUT' AND tx NOT IN (SELECT tx FROM legs WHERE line = 1 AND part % 3 = 0)""")
def emptied_groups(spark, sf):
    e = legs(spark, sf).withColumn("group_id", F.col("tx"))
    return ev.emptied_groups(e.where("line = 1 and part % 3 = 0"), e.where("direction = 'OUT'"))


@_query(f"""WITH {RAW}, c AS (SELECT o_custkey AS wallet, o_custkey * 10 AS lo, o_custkey * 10 + 99 AS hi FROM (SELECT DISTINCT o_custkey FROM orders) WHERE o_custkey % 4 > 0),
w AS (SELECT o_custkey AS wallet, o_custkey * 10 + (o_custkey % 9 - 4) * 60 AS x, o_custkey * 10 + (o_custkey % 9 - 4) * 60 + 80 AS y, CASE WHEN o_custkey % 5 > 0 THEN 'h' || o_custkey END AS g FROM (SELECT DISTINCT o_custkey FROM orders) WHERE o_custkey % 7 > 0),
j AS (SELECT coalesce(c.wallet, w.wallet) AS wallet, * EXCLUDE (wallet), CASE WHEN lo IS NULL THEN 'created' WHEN x IS NULL THEN 'unchanged' WHEN y > hi AND g IS NULL THEN 'refused' WHEN x > hi + 1 OR y + 1 < lo THEN 'disconnected' WHEN y > hi OR x < lo THEN 'merged' ELSE 'unchanged' END AS outcome
  FROM c FULL JOIN w ON c.wallet = w.wallet)
SELECT wallet, outcome, CASE outcome WHEN 'created' THEN x WHEN 'merged' THEN least(lo, x) ELSE lo END AS from_block, CASE outcome WHEN 'created' THEN y WHEN 'merged' THEN greatest(hi, y) ELSE hi END AS to_block,
CASE WHEN outcome = 'created' OR (outcome = 'merged' AND y > hi) THEN g ELSE CASE WHEN lo IS NOT NULL THEN 'old' END END AS block_hash FROM j""")
def cursor_advance(spark, sf):
    old, new = _cursors(spark, sf)
    return ev.merged_cursor(old, new, ["wallet"])


def _cursors(spark, sf):
    k = F.col("wallet")
    c = read(spark, sf, "orders").select(F.col("o_custkey").alias("wallet")).distinct()
    old = c.where(k % 4 > 0).select("wallet", (k * 10).alias("from_block"), (k * 10 + 99).alias("to_block"), F.lit("old").alias("block_hash"))
    low = k * 10 + (k % 9 - 4) * 60
    return old, c.where(k % 7 > 0).select("wallet", low.alias("from_block"), (low + 80).alias("to_block"), F.when(k % 5 > 0, F.concat(F.lit("h"), k.cast("string"))).alias("block_hash"))


@_query("""WITH k AS (SELECT DISTINCT o_custkey AS wallet FROM orders WHERE o_custkey % 4 > 0 AND o_custkey % 7 > 0), j AS (SELECT wallet, wallet * 10 AS lo, wallet * 10 + 99 AS hi, wallet * 10 + (wallet % 9 - 4) * 60 AS x FROM k)
SELECT wallet, CASE WHEN x > hi + 1 THEN 'disconnected-forward' WHEN x + 81 < lo THEN 'disconnected-backward' WHEN x >= lo AND x + 80 <= hi THEN 'contained' ELSE 'connected' END AS way,
CASE WHEN x > hi + 1 THEN x - hi - 1 WHEN x + 81 < lo THEN lo - x - 81 ELSE 0 END AS gap FROM j""")
def cursor_gaps(spark, sf):
    return ev.cursor_gap(*_cursors(spark, sf), ["wallet"])


@_query("""WITH s AS (SELECT c_custkey AS wallet, c_custkey * 37 AS lo, c_custkey * 37 + 250 AS hi FROM customer WHERE c_custkey <= 300), w AS (SELECT wallet, greatest(c * 100, lo) AS low, least(c * 100 + 99, hi) AS high FROM (SELECT *, unnest(range(lo // 100, hi // 100 + 1)) AS c FROM s))
SELECT wallet, low, high, row_number() OVER (PARTITION BY wallet ORDER BY low DESC) AS number FROM w""")
def aligned_windows(spark, sf):
    k = F.col("c_custkey")
    spans = read(spark, sf, "customer").where("c_custkey <= 300").select(k.alias("wallet"), (k * 37).alias("from_block"), (k * 37 + 250).alias("to_block"))
    return ev.aligned_windows(spans, 100, descending=True).select("wallet", "low", "high", "number")


@_query(f"""WITH {LEGS}, f AS (SELECT *, ['TRANSFERS', 'DEX', 'LP', 'STAKING'][line % 4 + 1] AS family FROM legs)
SELECT family, count(*) AS snapshots, count(DISTINCT CASE WHEN part % 2 = 0 THEN tx END) AS groups, greatest(count(*) - count(DISTINCT CASE WHEN part % 2 = 0 THEN tx END), 0) AS skipped FROM f GROUP BY ALL""")
def rebuild_report(spark, sf):
    names = F.array(*(F.lit(n) for n in ("TRANSFERS", "DEX", "LP", "STAKING")))
    s = legs(spark, sf).withColumn("family", names[F.col("line") % 4])
    return ev.rebuild_report(s, s.where("part % 2 = 0").select("family", F.col("tx").alias("group_id")))


@_query("""WITH n AS (SELECT o_orderdate::DATE AS day, lower(o_orderpriority) AS low, count(*) AS times, count(*) FILTER (WHERE o_orderpriority <> lower(o_orderpriority)) AS mixed FROM orders GROUP BY ALL)
SELECT count(*) FILTER (WHERE times > 1) AS repeated, sum(mixed)::BIGINT AS mixed_case FROM n""")
def identity_faults(spark, sf):
    return ev.identity_faults(read(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day"), "o_orderpriority"), ["day", "o_orderpriority"], "o_orderpriority")


@_query("""WITH b AS (SELECT o_orderkey, o_orderkey % 3 AS chain FROM orders WHERE o_orderkey % 5 < 4 AND o_orderkey % 41 = 0)
SELECT chain AS chain_id, count(*) AS mismatched, min(o_orderkey) AS from_block, least(max(o_orderkey), min(o_orderkey) + 999) AS to_block FROM b GROUP BY ALL""")
def reorg_window(spark, sf):
    o = F.col("o_orderkey")
    old = read(spark, sf, "orders").select((o % 3).alias("chain_id"), o.alias("block_number"), o.cast("string").alias("block_hash"))
    new = old.where("block_number % 5 < 4").withColumn("block_hash", F.when(F.col("block_number") % 41 == 0, "other").otherwise(F.col("block_hash")))
    return ev.reorged(old, new, 1000)


@_query(f"""WITH {RAW} SELECT block_number, log_index, part, strftime(occurred_at, '%Y-%m-%d') AS day FROM raw WHERE block_number <= 900""")
def block_times(spark, sf):
    raw = raw_transfers(spark, sf).where("block_number <= 900")
    blocks = raw.groupBy("block_number").agg(F.max(F.upper("block_hash")).alias("block_hash"))
    got = ledger.with_timestamps(raw, blocks.withColumn("timestamp", F.lit("2000-01-01").cast("timestamp")))
    return got.select("block_number", "log_index", "part", F.date_format("occurred_at", "yyyy-MM-dd").alias("day"))


@_query("""WITH o AS (SELECT o_orderkey AS tx, CASE WHEN o_orderkey % 6 = 0 THEN 0 ELSE o_totalprice END AS value, o_orderkey % 3 > 0 AS f, o_orderkey % 4 = 0 AS has, o_orderkey % 2 = 0 AS t, o_shippriority_fee AS fee FROM (SELECT *, (o_orderkey % 5)::DOUBLE AS o_shippriority_fee FROM orders)),
e AS (SELECT CASE WHEN f THEN 'SEND' ELSE 'RECEIVE' END AS entry_type, CASE WHEN f THEN 'OUT' ELSE 'IN' END AS direction, value AS q FROM o WHERE value <> 0 AND NOT has AND (f OR t) UNION ALL SELECT 'FEE', 'OUT', fee FROM o WHERE f AND fee <> 0)
SELECT entry_type, direction, count(*) AS entries, sum(q::DECIMAL(24,4))::DOUBLE AS quantity FROM e GROUP BY ALL""")
def normalize_native(spark, sf):
    o = F.col("o_orderkey")
    rows = read(spark, sf, "orders").select(o.alias("tx"), F.when(o % 6 == 0, 0.0).otherwise(F.col("o_totalprice")).alias("value"), (o % 3 > 0).alias("from_tracked"), (o % 2 == 0).alias("to_tracked"), (o % 4 == 0).alias("has_transfers"), (o % 5).cast("double").alias("fee"))
    return normalize.native(rows).groupBy("entry_type", "direction").agg(F.count("*").alias("entries"), F.sum(F.col("quantity").cast("decimal(24,4)")).cast("double").alias("quantity"))


@_query("""WITH s AS (SELECT o_orderkey AS tx, o_totalprice AS locked, (o_orderkey % 5)::DOUBLE AS fee FROM orders WHERE o_orderkey % 2 = 0), e AS (SELECT 'STAKE_START' AS entry_type, 0.0 AS q FROM s UNION ALL SELECT 'STAKE_PRINCIPAL_LOCKED', locked FROM s UNION ALL SELECT 'FEE', fee FROM s WHERE fee > 0
UNION ALL SELECT 'STAKE_LOCK', o_totalprice FROM orders WHERE o_orderkey % 2 = 1) SELECT entry_type, count(*) AS entries, sum(q::DECIMAL(24,4))::DOUBLE AS quantity FROM e GROUP BY ALL""")
def normalize_stake_start(spark, sf):
    o = F.col("o_orderkey")
    rows = read(spark, sf, "orders").select(o.alias("tx"), o.alias("stake"), F.lit("token").alias("asset"), F.col("o_totalprice").alias("locked"), (o % 5).cast("double").alias("fee"))
    got = normalize.stake_starts(rows.where("tx % 2 = 0")).unionByName(normalize.stake_locks(rows.where("tx % 2 = 1")))
    return got.groupBy("entry_type").agg(F.count("*").alias("entries"), F.sum(F.col("quantity").cast("decimal(24,4)")).cast("double").alias("quantity"))


@_query(f"""WITH {LEGS}, s AS (SELECT tx, count(DISTINCT asset) FILTER (WHERE direction = 'OUT') AS no, count(DISTINCT asset) FILTER (WHERE direction = 'IN') AS ni, list_sort(list_distinct(list(asset) FILTER (WHERE direction = 'OUT'))) AS o, list_sort(list_distinct(list(asset) FILTER (WHERE direction = 'IN'))) AS i FROM legs GROUP BY tx),
a AS (SELECT tx, CASE WHEN no = 2 THEN 'LP_ADD' ELSE 'LP_REMOVE' END AS kind, CASE WHEN no = 2 THEN i[1] ELSE o[1] END AS lp FROM s WHERE ((no = 2 AND ni = 1) OR (no = 1 AND ni = 2)) AND NOT list_has_any(o, i))
SELECT kind, CASE WHEN asset = lp THEN 'LP' ELSE 'PAIR' END AS side, count(*) AS edges FROM a JOIN legs USING (tx) GROUP BY ALL""")
def lp_evidence(spark, sf):
    from ..operators.shapes import lp_shape

    t = legs(spark, sf)
    actions = lp_shape(t.select("tx", "asset", "direction", "quantity")).where("reason is null")
    edges = ev.lp_evidence(actions, t.withColumn("transfer", F.col("line"))).join(actions.select("tx", "kind"), "tx")
    return edges.groupBy("kind", F.when(F.col("role") == "LP", "LP").otherwise("PAIR").alias("side")).agg(F.count("*").alias("edges"))


@_query(f"""WITH {LEGS} SELECT tx, count(*) AS transfers FROM legs GROUP BY ALL HAVING count(*) > 4""")
def transfers_per_transaction(spark, sf):
    return quality.duplicates(legs(spark, sf), ["tx"]).where("times > 4").select("tx", F.col("times").alias("transfers"))


@_query(f"WITH {LEGS} SELECT tx AS group_id FROM legs GROUP BY tx HAVING bool_and(part % 2 = 0)")
def removable_groups(spark, sf):
    e = legs(spark, sf).select(F.col("tx").alias("group_id"), F.col("part").alias("transfer"))
    return ledger.removable_groups(e, e.where("transfer % 2 = 0").select("transfer").distinct())


@_query(f"WITH {LEGS}, n AS (SELECT o_orderkey AS tx FROM orders) SELECT count(*) AS native FROM n WHERE tx NOT IN (SELECT tx FROM legs WHERE direction = 'OUT')")
def native_without_protocol(spark, sf):
    native = read(spark, sf, "orders").select(F.col("o_orderkey").alias("tx"))
    return ledger.without_protocol(native, legs(spark, sf).where("direction = 'OUT'").select("tx").distinct()).agg(F.count("*").alias("native"))


@_query("SELECT o_orderkey AS run, o_orderstatus AS state FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25")
def recent_runs(spark, sf):
    from ..operators.reports import recent

    return recent(read(spark, sf, "orders").select(F.col("o_orderkey").alias("run"), F.col("o_orderstatus").alias("state"), F.col("o_orderdate").alias("started_at"))).select("run", "state")


@_query("""WITH top AS (SELECT *, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' OR (o_orderdate = TIMESTAMP '1996-01-01' AND o_orderkey > 5000) QUALIFY place <= 41)
SELECT o_orderkey AS id, place, coalesce(string_agg(l_linenumber || '/' || l_partkey, ',' ORDER BY l_linenumber, l_partkey), '') AS entries, place = 40 AND (SELECT count(*) FROM top) > 40 AS is_cursor FROM top LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE place <= 40 GROUP BY o_orderkey, place""")
def transactions_with_entries(spark, sf):
    import datetime

    from ..operators.reports import page_with_entries

    groups = read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("occurred_at"))
    entries = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"))
    got = page_with_entries(groups, entries, 40, (datetime.datetime(1996, 1, 1), 5000))
    text = F.array_join(F.transform("entries", lambda x: F.concat_ws("/", x.line, x.part)), ",")
    return got.select("id", F.col("place").cast("long").alias("place"), F.coalesce(text, F.lit("")).alias("entries"), "is_cursor")

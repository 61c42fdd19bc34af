"""The ledger's queries over the driver's tables, each with its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import ledger, normalize, pnl, positions, pricing, quality, reports, shapes, staking
from ..sources.tables import LEGS, ORDER, PRICES, RAW, legs, prices, raw_transfers, read
from ..streaming import windows

_QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}
NOW = "1998-12-01 00:00:00"
AT = "2024-01-31 00:00:00"


def _query(sql: str | None):
    def add(f):
        _QUERIES[f.__name__] = (f, sql)
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _QUERIES.items() if sql}


def _utc(text: str):
    return F.lit(text).cast("timestamp")


def _transfers(spark, sf):
    return legs(spark, sf).select("tx", "asset", "direction", "quantity")


def _doubles(df, *texts):
    """Decimals, and the numbers that stand in ``texts``, as doubles, which both engines show alike."""
    return df.select(*(F.col(f.name).cast("double") if f.name in texts or f.dataType.typeName() == "decimal" else F.col(f.name) for f in df.schema.fields))


_FOLD = f"""WITH RECURSIVE {LEGS},
seq AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY wallet, asset ORDER BY {", ".join(ORDER)}) AS n FROM legs),
fold AS (
  SELECT wallet, asset, 0::BIGINT AS n, 0.0::DOUBLE AS h, 0.0::DOUBLE AS c, 0.0::DOUBLE AS r, 0::BIGINT AS s FROM seq WHERE n = 1
  UNION ALL
  SELECT f.wallet, f.asset, q.n,
    CASE WHEN q.direction = 'OUT' AND q.quantity > f.h THEN f.h WHEN q.direction = 'OUT' THEN f.h - q.quantity ELSE f.h + q.quantity END,
    CASE WHEN q.direction = 'OUT' AND q.quantity > f.h THEN f.c WHEN q.direction = 'OUT' THEN f.c - f.c / (CASE WHEN f.h = 0 THEN 1 ELSE f.h END) * q.quantity ELSE f.c + q.value END,
    CASE WHEN q.direction = 'OUT' AND q.quantity <= f.h THEN f.r + (q.value - f.c / (CASE WHEN f.h = 0 THEN 1 ELSE f.h END) * q.quantity) ELSE f.r END,
    CASE WHEN q.direction = 'OUT' AND q.quantity > f.h THEN f.s + 1 ELSE f.s END
  FROM fold f JOIN seq q ON f.wallet = q.wallet AND f.asset = q.asset AND q.n = f.n + 1),
last AS (SELECT * FROM fold QUALIFY row_number() OVER (PARTITION BY wallet, asset ORDER BY n DESC) = 1)
"""


@_query(_FOLD + "SELECT wallet, asset, round(h, 4) AS holdings, round(CASE WHEN h <> 0 THEN c / h END, 4) AS avg_cost, round(r, 4) AS realized, s AS skipped FROM last")
def pnl_average_cost(spark, sf):
    got = pnl.average_cost(legs(spark, sf), ORDER)
    return got.select("wallet", "asset", F.round("holdings", 4).alias("holdings"), F.round("avg_cost", 4).alias("avg_cost"), F.round("realized", 4).alias("realized"), "skipped")


@_query(_FOLD + """SELECT wallet, count(*) AS positions, count(*) FILTER (WHERE s = 0 AND h <> 0) AS complete, count(*) FILTER (WHERE s > 0) AS partial,
  count(*) FILTER (WHERE s = 0 AND h = 0) AS empty, sum(s)::BIGINT AS skipped_legs FROM last GROUP BY wallet""")  # fmt: skip
def pnl_status_rollup(spark, sf):
    return pnl.coverage(pnl.average_cost(legs(spark, sf), ORDER))


@_query(f"""WITH {LEGS} SELECT wallet, count(*) AS coupled FROM legs l WHERE EXISTS (
  SELECT 1 FROM legs o WHERE o.tx = l.tx AND o.asset <> l.asset AND o.direction <> l.direction AND o.quantity <> 0) GROUP BY wallet""")
def sibling_coupling(spark, sf):
    return pnl.coupled(legs(spark, sf).withColumn("entry_type", F.lit("LEG"))).groupBy("wallet").agg(F.count("*").alias("coupled"))


_SIDES = f"""WITH {LEGS},
sums AS (SELECT tx, direction, asset, sum(quantity) AS q FROM legs GROUP BY ALL),
sides AS (SELECT tx, list({{'a': asset, 'q': q}} ORDER BY asset) FILTER (WHERE direction = 'OUT') AS o, list({{'a': asset, 'q': q}} ORDER BY asset) FILTER (WHERE direction = 'IN') AS i FROM sums GROUP BY tx),
n AS (SELECT *, coalesce(len(o), 0) AS no, coalesce(len(i), 0) AS ni FROM sides)
"""


@_query(_SIDES + """, r AS (SELECT *, CASE WHEN no = 0 OR ni = 0 THEN 'one-sided' WHEN no > 1 OR ni > 1 THEN 'ambiguous-assets' WHEN o[1].a = i[1].a THEN 'same-asset' END AS reason FROM n)
SELECT tx, CASE WHEN reason IS NULL THEN o[1].a END AS sold_asset, CASE WHEN reason IS NULL THEN o[1].q END AS sold,
  CASE WHEN reason IS NULL THEN i[1].a END AS bought_asset, CASE WHEN reason IS NULL THEN i[1].q END AS bought, reason FROM r""")  # fmt: skip
def swap_shape(spark, sf):
    return shapes.swap_shape(_transfers(spark, sf))


_LP = _SIDES + """, s AS (SELECT *, list_has_any(coalesce(list_transform(o, lambda x: x.a), []), coalesce(list_transform(i, lambda x: x.a), [])) AS lap,
  CASE WHEN no = 2 AND ni = 1 THEN 'LP_ADD' WHEN no = 1 AND ni = 2 THEN 'LP_REMOVE' END AS k FROM n),
lp AS (SELECT tx, CASE WHEN NOT lap THEN k END AS kind, CASE WHEN k IS NULL THEN 'ambiguous-assets' WHEN lap THEN 'overlapping-assets' END AS reason,
  CASE WHEN lap THEN NULL WHEN k = 'LP_ADD' THEN i WHEN k = 'LP_REMOVE' THEN o END AS one, CASE WHEN lap THEN NULL WHEN k = 'LP_ADD' THEN o WHEN k = 'LP_REMOVE' THEN i END AS two FROM s)
"""


@_query(_LP + "SELECT tx, kind, one[1].a AS lp_asset, two[1].a AS asset0, two[2].a AS asset1, reason FROM lp")
def lp_shape(spark, sf):
    return shapes.lp_shape(_transfers(spark, sf)).drop("lp", "amount0", "amount1")


@_query(f"""WITH {LEGS}, n AS (SELECT tx, count(*) FILTER (WHERE direction = 'OUT') AS n_out, count(*) FILTER (WHERE direction = 'IN') AS n_in FROM legs GROUP BY tx)
SELECT *, CASE WHEN n_out = 1 AND n_in = 0 THEN 'STAKE_START' WHEN n_out = 0 AND n_in = 1 THEN 'STAKE_END' END AS kind FROM n""")
def stake_shape(spark, sf):
    return shapes.stake_shape(_transfers(spark, sf))


@_query(_SIDES + "SELECT tx, CASE WHEN no = 1 AND ni = 1 THEN 'SWAP' ELSE 'LP' END AS protocol FROM n WHERE (no = 1 AND ni = 1 AND o[1].a <> i[1].a) OR (no = 2 AND ni = 1) OR (no = 1 AND ni = 2)")
def inline_protocols(spark, sf):
    return shapes.inline_protocol(_transfers(spark, sf))


_CALLS = """calls AS (SELECT tx, min(from_address) AS sender, max(to_address) AS receiver FROM raw GROUP BY tx)"""


@_query(f"""WITH {RAW}, {_CALLS}, n AS (SELECT tx, count(DISTINCT asset) FILTER (WHERE from_address = sender) AS no, count(DISTINCT asset) FILTER (WHERE to_address = receiver) AS ni, min(asset) FILTER (WHERE from_address = sender) AS o, min(asset) FILTER (WHERE to_address = receiver) AS i,
  bool_or(receiver = '0x' || lpad('1000000007', 40, '0') AND asset LIKE '%7') AS staked FROM raw JOIN calls USING (tx) GROUP BY tx)
SELECT tx FROM n WHERE staked OR (no = 2 AND ni = 1) OR (no = 1 AND ni = 2) OR (no = 1 AND ni = 1 AND o <> i)""")
def inferred_protocols(spark, sf):
    """Protocols by the sender and receiver of the call; the contract of one supplier stakes its own token."""
    raw, contract = raw_transfers(spark, sf), "0x" + "1000000007".rjust(40, "0")
    calls = raw.groupBy("tx").agg(F.min("from_address").alias("from_address"), F.max("to_address").alias("to_address"))
    token = F.when(F.col("asset").endswith("7"), contract.upper().replace("0X", "0x")).otherwise(F.col("asset"))
    return shapes.inferred_protocols(raw.withColumn("token_address", token), calls, contract)


def _counted(rows):
    return rows.groupBy("entry_type", "direction").agg(F.count("*").alias("entries"), F.sum(F.col("quantity").cast("decimal(24,4)")).cast("double").alias("quantity"))


@_query(f"""WITH {LEGS}, t AS (SELECT *, direction = 'OUT' OR line = 1 AS f, direction = 'IN' AND supplier % 3 > 0 AS g FROM legs),
e AS (SELECT CASE WHEN f AND g THEN 'INTERNAL_TRANSFER' WHEN g THEN 'RECEIVE' WHEN f THEN 'SEND' END AS entry_type, quantity FROM t WHERE f OR g)
SELECT entry_type, CASE entry_type WHEN 'SEND' THEN 'OUT' WHEN 'RECEIVE' THEN 'IN' ELSE 'INTERNAL' END AS direction, count(*) AS entries, sum(quantity) AS quantity FROM e GROUP BY ALL""")
def normalize_transfers(spark, sf):
    rows = legs(spark, sf).withColumns({"from_tracked": (F.col("direction") == "OUT") | (F.col("line") == 1), "to_tracked": (F.col("direction") == "IN") & (F.col("supplier") % 3 > 0)})
    return _counted(normalize.transfers(rows))


def _fees(spark, sf):
    return legs(spark, sf).groupBy("tx").agg(F.sum(F.col("fee").cast("decimal(18,4)")).cast("double").alias("fee"))


_FEES = "fees AS (SELECT tx, sum(fee::DECIMAL(18,4))::DOUBLE AS fee FROM legs GROUP BY tx)"


@_query(_SIDES + f""", {_FEES}, w AS (SELECT n.*, fee FROM n JOIN fees USING (tx) WHERE no = 1 AND ni = 1 AND o[1].a <> i[1].a),
e AS (SELECT 'SWAP_OUT' AS entry_type, 'OUT' AS direction, o[1].q AS q FROM w UNION ALL SELECT 'SWAP_IN', 'IN', i[1].q FROM w UNION ALL SELECT 'FEE', 'OUT', fee FROM w WHERE fee > 0)
SELECT entry_type, direction, count(*) AS entries, sum(q::DECIMAL(24,4))::DOUBLE AS quantity FROM e GROUP BY ALL""")
def normalize_swaps(spark, sf):
    return _counted(normalize.swaps(shapes.swap_shape(_transfers(spark, sf)).where("reason is null").join(_fees(spark, sf), "tx")))


def _lp_actions(spark, sf):
    return shapes.lp_shape(_transfers(spark, sf)).where("reason is null").drop("reason")


@_query(_LP + f""", {_FEES}, w AS (SELECT lp.*, fee FROM lp JOIN fees USING (tx) WHERE reason IS NULL),
e AS (SELECT CASE WHEN kind = 'LP_ADD' THEN 'LP_ADD_OUT' ELSE 'LP_REMOVE_IN' END AS entry_type, CASE WHEN kind = 'LP_ADD' THEN 'OUT' ELSE 'IN' END AS direction, unnest([two[1].q, two[2].q]) AS q FROM w
  UNION ALL SELECT CASE WHEN kind = 'LP_ADD' THEN 'LP_ADD_IN' ELSE 'LP_REMOVE_OUT' END, CASE WHEN kind = 'LP_ADD' THEN 'IN' ELSE 'OUT' END, one[1].q FROM w UNION ALL SELECT 'FEE', 'OUT', fee FROM w WHERE fee > 0)
SELECT entry_type, direction, count(*) AS entries, sum(q::DECIMAL(24,4))::DOUBLE AS quantity FROM e GROUP BY ALL""")
def normalize_lp(spark, sf):
    return _counted(normalize.liquidity(_lp_actions(spark, sf).join(_fees(spark, sf), "tx")))


def _ends(spark, sf):
    return legs(spark, sf).where("direction = 'IN'").select("wallet", "tx", F.col("tx").alias("stake"), "asset", F.when(F.col("line") % 5 > 0, F.col("supplier") % 50 + 0.0).alias("locked"), F.col("quantity").alias("total"), F.lit(0.0).alias("fee"))


@_query(f"""WITH {LEGS}, d AS (SELECT CASE WHEN line % 5 > 0 THEN (supplier % 50)::DOUBLE END AS k, quantity AS t FROM legs WHERE direction = 'IN'),
e AS (SELECT 'STAKE_END' AS entry_type, 'INTERNAL' AS direction, 0.0::DOUBLE AS q FROM d UNION ALL SELECT 'STAKE_PRINCIPAL_RETURNED', 'IN', least(k, t) FROM d WHERE least(k, t) > 0 AND k IS NOT NULL
  UNION ALL SELECT 'STAKE_YIELD_RECEIVED', 'IN', t - k FROM d WHERE t > k UNION ALL SELECT 'STAKE_PENALTY', 'OUT', k - t FROM d WHERE k > t UNION ALL SELECT 'STAKE_RETURN_UNALLOCATED', 'IN', t FROM d WHERE k IS NULL AND t <> 0)
SELECT entry_type, direction, count(*) AS entries, sum(q) AS quantity FROM e GROUP BY ALL""")
def normalize_stake_end(spark, sf):
    return _counted(normalize.stake_ends(_ends(spark, sf)))


@_query("SELECT 'le_' || sha256(json_object('chainId', 369, 'walletId', 'w' || o_custkey, 'txHash', 't' || o_orderkey, 'note', NULL)) AS id FROM orders")
def ledger_ids(spark, sf):
    o = read(spark, sf, "orders")
    return o.select(scalars.content_id("le_", F.lit(369).alias("chainId"), F.concat(F.lit("w"), "o_custkey").alias("walletId"), F.concat(F.lit("t"), "o_orderkey").alias("txHash"), F.lit(None).cast("string").alias("note")).alias("id"))


_KINDS = "['TRANSFER', 'SWAP', 'LP_ADD', 'LP_REMOVE', 'HEX_STAKE_LOCK', 'HEX_STAKE_START', 'HEX_STAKE_END']"


def _actions(rows):
    kinds = F.array(*(F.lit(k) for k in ("TRANSFER", "SWAP", "LP_ADD", "LP_REMOVE", "HEX_STAKE_LOCK", "HEX_STAKE_START", "HEX_STAKE_END")))
    return rows.withColumn("action_type", F.element_at(kinds, (F.col("part") % 7 + 1).cast("int")))


_SEQ = "struct_pack(line, part, supplier, price, quantity)"


@_query(f"""WITH {LEGS}, a AS (SELECT *, {_KINDS}[part % 7 + 1] AS action_type FROM legs),
f AS (SELECT wallet, tx, action_type, fee FROM a QUALIFY row_number() OVER (PARTITION BY wallet, tx
  ORDER BY list_position(['HEX_STAKE_END', 'HEX_STAKE_START', 'HEX_STAKE_LOCK', 'SWAP', 'LP_ADD', 'LP_REMOVE', 'TRANSFER'], action_type), line, part, supplier, price, quantity) = 1)
SELECT wallet, action_type, count(*) AS fees, sum(fee::DECIMAL(18,4))::DOUBLE AS fee FROM f GROUP BY ALL""")
def fee_owner(spark, sf):
    rows = _actions(legs(spark, sf)).withColumns({"chain_id": F.lit(369), "seq": F.struct("line", "part", "supplier", "price", "quantity")})
    return ledger.fee_owners(rows).groupBy("wallet", "action_type").agg(F.count("*").alias("fees"), F.sum(F.col("fee").cast("decimal(18,4)")).cast("double").alias("fee"))


def _evidence(spark, sf, k):
    rows = read(spark, sf, "lineitem").where(F.col("l_suppkey") % 3 == k)
    status = F.when(F.col("l_linestatus") == "F", "REORGED").otherwise("ACTIVE").alias("status")
    return rows.select(F.col("l_orderkey").alias("transfer"), status, F.when(F.col("l_linenumber") <= 2, "RECORDED").otherwise("VERIFIED_EMPTY").alias("evidence"))


@_query(f"""WITH {LEGS}, used AS (SELECT DISTINCT tx FROM legs WHERE status = 'ACTIVE' AND line <= 2 AND supplier % 3 IN (0, 1, 2))
SELECT asset, count(*) AS transfers, sum(quantity) AS quantity FROM legs WHERE tx NOT IN (SELECT tx FROM used) GROUP BY asset""")
def shadow_suppression(spark, sf):
    used = ledger.consumed(*(_evidence(spark, sf, k) for k in range(3)))
    left = ledger.suppress(legs(spark, sf).withColumn("transfer", F.col("tx")), used)
    return left.groupBy("asset").agg(F.count("*").alias("transfers"), F.sum("quantity").alias("quantity"))


@_query(f"WITH {LEGS} SELECT DISTINCT tx FROM legs WHERE direction = 'OUT'")
def protocol_tx_union(spark, sf):
    rows = legs(spark, sf).where("direction = 'OUT'")
    return ledger.protocol_transactions(*(rows.where(F.col("supplier") % 3 == k) for k in range(3)))


@_query(f"""WITH {LEGS}, b AS (SELECT wallet, asset, sum(CASE direction WHEN 'IN' THEN quantity ELSE -quantity END) AS balance FROM legs WHERE status = 'ACTIVE' GROUP BY ALL)
SELECT * FROM b WHERE balance <> 0""")
def token_balances(spark, sf):
    return _doubles(positions.token_balances(legs(spark, sf).where("status = 'ACTIVE'")).drop("warning"), "balance")


@_query(f"""WITH {RAW}, e AS (SELECT from_address AS wallet, asset, -(amount_raw::HUGEINT) * 1000000000000000000::HUGEINT AS q FROM raw UNION ALL SELECT to_address, asset, amount_raw::HUGEINT * 1000000000000000000::HUGEINT FROM raw)
SELECT wallet, asset, sum(q)::VARCHAR AS balance FROM e GROUP BY ALL HAVING sum(q) <> 0""")
def raw_balances(spark, sf):
    """Raw integer amounts, beyond what a decimal's sum may hold, for both ends of every transfer."""
    raw = raw_transfers(spark, sf).select("asset", F.concat("amount_raw", F.lit("0" * 18)).alias("quantity"), F.explode(F.array(F.struct(F.col("from_address").alias("wallet"), F.lit("OUT").alias("direction")), F.struct(F.col("to_address").alias("wallet"), F.lit("IN").alias("direction")))).alias("side"))
    return positions.token_balances(raw.select("asset", "quantity", "side.*")).drop("warning")


@_query(f"""WITH {LEGS}, sums AS (SELECT tx, direction, asset, sum(round(quantity * 100)::HUGEINT * 1000000000000000000000000000000::HUGEINT) AS q FROM legs GROUP BY ALL),
n AS (SELECT tx, list({{'a': asset, 'q': q}}) FILTER (WHERE direction = 'OUT') AS o, list({{'a': asset, 'q': q}}) FILTER (WHERE direction = 'IN') AS i FROM sums GROUP BY tx)
SELECT tx, o[1].a AS sold_asset, o[1].q::VARCHAR AS sold, i[1].a AS bought_asset, i[1].q::VARCHAR AS bought FROM n WHERE len(o) = 1 AND len(i) = 1 AND o[1].a <> i[1].a""")
def raw_swaps(spark, sf):
    """Swaps of raw integer amounts of 30 digits and more."""
    raw = _transfers(spark, sf).withColumn("quantity", F.concat(F.round(F.col("quantity") * 100).cast("long").cast("string"), F.lit("0" * 30)))
    return shapes.swap_shape(raw).where("reason is null").drop("reason")


@_query(f"""WITH {LEGS}, b AS (SELECT tx AS wallet, asset, sum(CASE direction WHEN 'IN' THEN quantity ELSE -quantity END) AS balance FROM legs GROUP BY ALL)
SELECT wallet, count(*) AS negative, sum(balance) AS short FROM b WHERE balance < 0 GROUP BY wallet""")
def negative_balances(spark, sf):
    got = positions.token_balances(legs(spark, sf).withColumn("wallet", F.col("tx"))).where("warning is not null")
    return got.groupBy("wallet").agg(F.count("*").alias("negative"), F.sum(F.col("balance").cast("decimal(28,4)")).cast("double").alias("short"))


@_query(_LP + """SELECT one[1].a AS lp_asset, sum(CASE kind WHEN 'LP_ADD' THEN one[1].q ELSE -one[1].q END) AS lp, arg_min(two[1].a, tx) AS asset0, arg_min(two[2].a, tx) AS asset1,
  sum(CASE kind WHEN 'LP_ADD' THEN two[1].q ELSE -two[1].q END) AS amount0, sum(CASE kind WHEN 'LP_ADD' THEN two[2].q ELSE -two[2].q END) AS amount1
FROM lp WHERE reason IS NULL GROUP BY ALL HAVING lp <> 0 OR amount0 <> 0 OR amount1 <> 0""")  # fmt: skip
def lp_positions(spark, sf):
    drafts = normalize.liquidity(_lp_actions(spark, sf).withColumn("fee", F.lit(0.0)))
    return _doubles(positions.liquidity_positions(drafts.withColumn("wallet", F.lit(1))).drop("wallet"), "lp", "amount0", "amount1")


@_query(_LP + "SELECT CASE WHEN ni = 0 THEN 'lp-position-missing-lp-leg' ELSE 'lp-position-ambiguous-underlyings:' || no END AS warning, count(*) AS actions FROM (SELECT coalesce(len(o), 0) AS no, coalesce(len(i), 0) AS ni FROM sides) WHERE ni = 0 OR no <> 2 GROUP BY ALL")
def lp_warnings(spark, sf):
    kind = F.when(F.col("direction") == "OUT", "LP_ADD_OUT").otherwise("LP_ADD_IN")
    sums = legs(spark, sf).groupBy("tx", "direction", "asset").agg(F.sum("quantity").alias("quantity"))
    got = positions.liquidity_warnings(sums.withColumns({"entry_type": kind, "wallet": F.lit(1)}))
    return got.groupBy("warning").agg(F.count("*").alias("actions"))


@_query(f"""WITH {LEGS}, d AS (SELECT wallet, tx, CASE WHEN line % 5 > 0 THEN (supplier % 50)::DOUBLE END AS k, quantity AS t FROM legs WHERE direction = 'IN')
SELECT wallet, tx AS stake, 0.0::DOUBLE AS principal, sum(CASE WHEN k IS NOT NULL AND least(k, t) > 0 THEN least(k, t) END) AS returned, sum(CASE WHEN t > k THEN t - k END) AS yield_received,
  sum(CASE WHEN k > t THEN k - t END) AS penalty, sum(CASE WHEN k IS NULL AND t <> 0 THEN t END) AS unallocated, 'ENDED' AS status FROM d GROUP BY ALL""")
def stake_positions(spark, sf):
    wallets = legs(spark, sf).select("tx", "wallet").distinct()
    return _doubles(positions.stake_positions(normalize.stake_ends(_ends(spark, sf)).join(wallets, "tx")), "principal", "returned", "yield_received", "penalty", "unallocated")


def _asked(spark, sf):
    e = read(spark, sf, "events").where("event_type = 'purchase'")
    return e.select(F.col("event_id").alias("leg"), F.col("user_id").alias("asset"), F.col("ts").cast("timestamp").alias("at"))


def _best(extra: str) -> str:
    return f"""WITH {PRICES}, l AS (SELECT event_id AS leg, user_id AS asset, ts AS asked FROM events WHERE event_type = 'purchase'),
m AS (SELECT leg, price_id, price FROM l JOIN prices USING (asset) WHERE source_type <> 'DEXSCREENER' AND observed_at + INTERVAL 1 DAY >= asked AND confidence >= 0.5 {extra}
  QUALIFY row_number() OVER (PARTITION BY leg ORDER BY CASE source_type WHEN 'ONCHAIN_POOL' THEN 5 WHEN 'ONCHAIN_ROUTE' THEN 4 WHEN 'ORACLE' THEN 3 ELSE 2 END DESC, confidence DESC, observed_at DESC, price_id) = 1)
SELECT leg, asset, price_id, price FROM l LEFT JOIN m USING (leg)"""


@_query(_best(""))
def best_price_asof(spark, sf):
    return pricing.best_prices(_asked(spark, sf), prices(spark, sf))


@_query(_best("AND observed_at <= asked"))
def best_price_strict(spark, sf):
    return pricing.best_prices(_asked(spark, sf), prices(spark, sf), strict=True)


_REASON = f"""WITH {PRICES}, j AS (SELECT *, CASE WHEN source_type = 'DEXSCREENER' THEN 'SOURCE_DISABLED' WHEN observed_at + INTERVAL 1 DAY < TIMESTAMP '{AT}' - INTERVAL 15 DAY THEN 'STALE' WHEN confidence < 0.5 THEN 'LOW_CONFIDENCE' END AS reason FROM prices)"""


def _then():
    return _utc(AT) - F.expr("interval 15 days")


@_query(_REASON + "SELECT coalesce(reason, 'ELIGIBLE') AS reason, source_type, count(*) AS observations FROM j GROUP BY ALL")
def price_reject_reasons(spark, sf):
    got = prices(spark, sf).withColumn("reason", F.coalesce(pricing.reject_reason(_then(), 0.5), F.lit("ELIGIBLE")))
    return got.groupBy("reason", "source_type").agg(F.count("*").alias("observations"))


@_query(_REASON + """, s(source_type) AS (VALUES ('ONCHAIN_POOL'), ('ONCHAIN_ROUTE'), ('ORACLE'), ('MANUAL'), ('DEXSCREENER'), ('OFFLINE')),
g AS (SELECT source_type, count(*) AS n, count(reason) AS bad, arg_max(coalesce(reason, 'OK'), observed_at) AS lr FROM j GROUP BY source_type)
SELECT source_type, coalesce(n, 0) AS observations, coalesce(bad, 0) AS rejected, CASE WHEN n IS NULL THEN 'unavailable' WHEN lr IN ('SOURCE_DISABLED', 'LOW_CONFIDENCE') THEN 'ineligible' WHEN lr = 'STALE' THEN 'stale' ELSE 'available' END AS status
FROM s LEFT JOIN g USING (source_type)""")  # fmt: skip
def pricing_status(spark, sf):
    known = spark.createDataFrame([(k,) for k in ("ONCHAIN_POOL", "ONCHAIN_ROUTE", "ORACLE", "MANUAL", "DEXSCREENER", "OFFLINE")], "source_type string")
    return pricing.pricing_status(known, prices(spark, sf), _then()).drop("latest")


@_query("""SELECT CASE WHEN c_acctbal IS NULL THEN 0.5 WHEN c_acctbal * 200 >= 1000000 THEN 0.95 WHEN c_acctbal * 200 >= 100000 THEN 0.85 WHEN c_acctbal * 200 >= 10000 THEN 0.7 WHEN c_acctbal * 200 >= 1000 THEN 0.55 ELSE 0.3 END::DOUBLE AS confidence,
count(*) AS pools FROM customer GROUP BY ALL""")
def liquidity_confidence(spark, sf):
    c = read(spark, sf, "customer")
    return c.select(scalars.liquidity_confidence(F.col("c_acctbal") * 200).alias("confidence")).groupBy("confidence").agg(F.count("*").alias("pools"))


@_query(f"""WITH {LEGS}, b AS (SELECT wallet, asset, sum(CASE direction WHEN 'IN' THEN quantity ELSE -quantity END) AS balance FROM legs GROUP BY ALL HAVING balance <> 0),
r AS (SELECT wallet, asset, asset = 'Brand#11' AS nat, CASE WHEN asset LIKE '%5' THEN 'UNKNOWN_TOKEN' WHEN balance <= 0 THEN 'NO_BALANCE' WHEN asset LIKE '%3' THEN 'LP_TOKEN' END AS reason FROM b),
k AS (SELECT *, CASE WHEN reason IS NULL THEN row_number() OVER (PARTITION BY wallet, reason IS NULL ORDER BY nat DESC, asset) END::INTEGER AS rank FROM r)
SELECT wallet, asset, reason, rank, rank <= 10 AS chosen FROM k""")
def ingest_candidates(spark, sf):
    tokens = read(spark, sf, "part").select(F.col("p_brand").alias("asset")).distinct()
    tokens = tokens.select("asset", F.when(~F.col("asset").endswith("5"), 18).alias("decimals"), F.col("asset").endswith("3").alias("is_lp"), (F.col("asset") == "Brand#11").alias("is_native"))
    return pricing.ingest_candidates(_doubles(positions.token_balances(legs(spark, sf)), "balance"), tokens, 10)


_DAY = "date_diff('day', DATE '1992-01-01', {}::DATE)"
_STAKES = f"""days AS (SELECT {_DAY.format("o_orderdate")} AS day, (count(*) % 7 * 1000)::BIGINT AS payout, (count(*) % 5 * 100)::BIGINT AS total FROM orders GROUP BY 1),
stakes AS (SELECT o_orderkey AS stake, {_DAY.format("o_orderdate")} AS locked, o_orderkey % 20 + 1 AS staked, o_custkey % 97 AS shares FROM orders)"""


def _day(column):
    return F.datediff(F.col(column), F.lit("1992-01-01").cast("date"))


def _stakes(spark, sf):
    o = read(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("stake"), _day("o_orderdate").alias("locked_day"), (F.col("o_orderkey") % 20 + 1).cast("int").alias("staked_days"), (F.col("o_custkey") % 97).alias("shares"))


@_query(f"""WITH {_STAKES}, g AS (SELECT stake, sum(CASE WHEN total > 0 THEN (shares * payout) // total ELSE 0 END)::BIGINT AS yield_units, count(*) AS n FROM stakes JOIN days ON day >= locked AND day < locked + staked GROUP BY stake)
SELECT stake, staked AS staked_days, coalesce(n, 0) AS days_seen, yield_units FROM stakes LEFT JOIN g USING (stake)""")
def stake_yield(spark, sf):
    o = read(spark, sf, "orders")
    days = o.groupBy(_day("o_orderdate").alias("day")).agg((F.count("*") % 7 * 1000).alias("payout"), (F.count("*") % 5 * 100).alias("total_shares"))
    return staking.stake_yield(_stakes(spark, sf), days).withColumn("staked_days", F.col("staked_days").cast("long"))


_OBS = f"""obs AS (SELECT l_orderkey AS stake, l_suppkey AS b, l_linenumber AS ln, l_partkey AS p, {_DAY.format("l_shipdate")} - l_linenumber * 20 AS f, {_DAY.format("l_shipdate")} + 20 AS t, l_returnflag = 'A' AS inv FROM lineitem)"""


def _observations(spark, sf):
    d = _day("l_shipdate")
    return read(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("stake"), F.col("l_suppkey").alias("observed_block"), F.struct("l_linenumber", "l_partkey", "l_shipdate").alias("observation"),
        (d - F.col("l_linenumber") * 20).alias("observed_from"), (d + 20).alias("observed_to"), (F.col("l_returnflag") == "A").alias("invalidated"),
    )


@_query(f"""WITH {_STAKES}, {_OBS}, n AS (SELECT * FROM obs QUALIFY row_number() OVER (PARTITION BY stake ORDER BY b DESC, ln, p, t) = 1)
SELECT CASE WHEN stakes.stake % 11 = 0 THEN 'unsupported' WHEN shares <= 0 THEN 'invalid_observation' WHEN f IS NULL THEN 'insufficient_observations' WHEN inv THEN 'invalid_observation' WHEN 2000 <= locked THEN 'insufficient_observations'
  WHEN f > locked OR t < least(1999, locked + staked - 1) THEN 'insufficient_observations' ELSE 'estimated' END AS status, count(*) AS stakes FROM stakes LEFT JOIN n USING (stake) GROUP BY 1""")
def yield_gates(spark, sf):
    stakes = _stakes(spark, sf).withColumn("chain_id", F.when(F.col("stake") % 11 == 0, 1).otherwise(369))
    return staking.gated_yields(stakes, _observations(spark, sf), F.lit(2000)).groupBy("status").agg(F.count("*").alias("stakes"))


@_query(f"""WITH {_STAKES}, {_OBS}, h AS (SELECT stake, min(f) AS lo, max(t) AS hi FROM obs WHERE NOT inv GROUP BY stake),
s AS (SELECT (stake % 3)::INTEGER AS chain_id, CASE WHEN 500 <= locked THEN 'n' WHEN lo <= locked AND hi >= 499 THEN 'c' ELSE 'm' END AS s FROM stakes LEFT JOIN h USING (stake))
SELECT chain_id, count(*) AS stakes, count(*) FILTER (WHERE s = 'c') AS covered, count(*) FILTER (WHERE s = 'm') AS missing, count(*) FILTER (WHERE s = 'n') AS no_elapsed_days FROM s GROUP BY 1""")
def evidence_coverage(spark, sf):
    stakes = _stakes(spark, sf).withColumn("chain_id", (F.col("stake") % 3).cast("int"))
    return staking.coverage(stakes, _observations(spark, sf), F.lit(500))


@_query("""WITH w AS (SELECT o_orderkey AS k, (o_custkey::HUGEINT << 72) | (o_orderkey::HUGEINT * 1000003) AS p FROM orders)
SELECT k, (p & ((1::HUGEINT << 72) - 1))::VARCHAR AS payout, (p >> 72)::VARCHAR AS shares, '0' AS sats, NULL::VARCHAR AS error FROM w""")
def packed_decode(spark, sf):
    word = (F.col("o_custkey").cast("decimal(38,0)") * F.lit(1 << 36).cast("decimal(12,0)") * F.lit(1 << 36).cast("decimal(12,0)") + (F.col("o_orderkey") * 1000003).cast("decimal(38,0)")).cast("string")
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), scalars.decode_packed(word).alias("d")).select("k", "d.*")


@_query("""WITH g AS (SELECT o_orderkey AS id, o_orderdate AS occurred_at, CASE WHEN o_custkey % 4 = 0 THEN 'TRANSFERS' WHEN o_custkey % 4 = 1 THEN 'DEX' WHEN o_custkey % 4 = 2 THEN 'LP' ELSE 'STAKING' END AS family FROM orders),
p AS (SELECT * FROM g WHERE occurred_at < TIMESTAMP '1996-01-01' OR (occurred_at = TIMESTAMP '1996-01-01' AND id > 5000) ORDER BY occurred_at DESC, id LIMIT 50)
SELECT id, family, coalesce(n, 0) AS n_entries, q AS quantity FROM p LEFT JOIN (SELECT l_orderkey AS id, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1) USING (id)""")
def transactions_page(spark, sf):
    kinds = F.array(*(F.lit(k) for k in ("TRANSFER", "SWAP", "LP_ADD", "HEX_STAKE_END")))
    groups = read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("occurred_at"), F.element_at(kinds, (F.col("o_custkey") % 4 + 1).cast("int")).alias("action_type"))
    entries = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_quantity").alias("quantity"))
    import datetime

    return reports.page(groups, entries, 50, (datetime.datetime(1996, 1, 1), 5000)).drop("occurred_at")


@_query(f"""WITH {LEGS}, b AS (SELECT wallet, asset, sum(CASE direction WHEN 'IN' THEN quantity ELSE -quantity END) AS balance FROM legs GROUP BY ALL HAVING balance <> 0),
p AS (SELECT p_brand AS asset, max(p_size)::DOUBLE AS price FROM part WHERE p_brand NOT LIKE '%4' GROUP BY 1), g AS (SELECT wallet, count(*) AS n, count(price) AS v, sum(balance * price) AS total_value FROM b LEFT JOIN p USING (asset) GROUP BY 1)
SELECT wallet, n AS positions, v AS valued, n - v AS unvalued, total_value, CASE WHEN v = n THEN 'complete' WHEN v = 0 THEN 'unavailable' ELSE 'partial' END AS status FROM g""")
def portfolio_summary(spark, sf):
    price = read(spark, sf, "part").where("p_brand not like '%4'").groupBy(F.col("p_brand").alias("asset")).agg(F.max("p_size").cast("double").alias("price"))
    return reports.portfolio_summary(_doubles(positions.token_balances(legs(spark, sf)), "balance").join(price, "asset", "left"))


@_query(f"""WITH s AS (SELECT o_custkey, max(o_orderdate) FILTER (WHERE o_orderstatus <> 'P') AS u FROM orders GROUP BY 1)
SELECT CASE WHEN u IS NULL THEN 'unknown' WHEN epoch(TIMESTAMP '{NOW}' - u) > 31536000 THEN 'stale' ELSE 'fresh' END AS freshness, count(*) AS wallets FROM s GROUP BY 1""")
def freshness(spark, sf):
    states = read(spark, sf, "orders").groupBy("o_custkey").agg(F.max(F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate"))).cast("timestamp").alias("updated_at"))
    return reports.freshness(states, _utc(NOW), 31536000).groupBy("freshness").agg(F.count("*").alias("wallets"))


@_query(f"""WITH s AS (SELECT p_brand AS asset, p_type AS source_kind, CASE WHEN p_brand LIKE '%1' THEN 8 ELSE p_size % 3 END AS decimals, o_orderdate AS observed_at FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey),
r AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY observed_at DESC, source_kind, decimals) AS rn FROM s)
SELECT asset, max(CASE WHEN rn = 1 THEN source_kind END) AS source_kind, CASE WHEN count(DISTINCT decimals) > 1 THEN 'conflicting' WHEN epoch(TIMESTAMP '{NOW}' - max(observed_at)) > 2592000 THEN 'stale' ELSE 'observed' END AS status FROM r GROUP BY asset""")
def metadata_status(spark, sf):
    line, part, orders = (read(spark, sf, t) for t in ("lineitem", "part", "orders"))
    rows = line.join(part, F.col("l_partkey") == F.col("p_partkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return reports.metadata_status(rows.select(F.col("p_brand").alias("asset"), F.col("p_type").alias("source_kind"), F.when(F.col("p_brand").endswith("1"), 8).otherwise(F.col("p_size") % 3).alias("decimals"), F.col("o_orderdate").cast("timestamp").alias("observed_at")), _utc(NOW))


_RUNS = "runs AS (SELECT event_id AS run, user_id AS wallet, ts AS started_at, ['PENDING', 'RUNNING', 'SUCCESS', 'FAILED'][event_id % 4 + 1] AS state FROM events)"


def _runs(spark, sf):
    kinds = F.array(*(F.lit(k) for k in ("PENDING", "RUNNING", "SUCCESS", "FAILED")))
    return read(spark, sf, "events").select(F.col("event_id").alias("run"), F.col("user_id").alias("wallet"), F.col("ts").cast("timestamp").alias("started_at"), F.element_at(kinds, (F.col("event_id") % 4 + 1).cast("int")).alias("state"))


@_query(f"""WITH {_RUNS}, a AS (SELECT state, floor(epoch(TIMESTAMP '{AT}' - started_at))::BIGINT AS age FROM runs)
SELECT state, (state = 'PENDING' AND age > 900) OR (state = 'RUNNING' AND age > 3600) AS stale, count(*) AS runs, max(age) AS max_age_s FROM a WHERE age >= 0 GROUP BY ALL""")
def ops_status(spark, sf):
    return reports.run_status(_runs(spark, sf).where(F.col("started_at") <= _utc(AT)), _utc(AT)).groupBy("state", "stale").agg(F.count("*").alias("runs"), F.max("age_s").alias("max_age_s"))


@_query(f"""WITH {_RUNS}, a AS (SELECT state, floor(epoch(TIMESTAMP '{AT}' - started_at))::BIGINT AS age FROM runs WHERE state IN ('PENDING', 'RUNNING') AND started_at <= TIMESTAMP '{AT}')
SELECT state, count(*) AS runs, count(*) FILTER (WHERE age > CASE state WHEN 'PENDING' THEN 900 ELSE 3600 END) AS stale_runs, min(age) AS min_age_s, max(age) AS max_age_s FROM a GROUP BY 1""")
def blocker_summary(spark, sf):
    return reports.blockers(_runs(spark, sf).where(F.col("started_at") <= _utc(AT)), _utc(AT))


@_query(f"""WITH {_RUNS}, g AS (SELECT wallet, count(*) AS runs, arg_max(state, started_at) AS l, bool_or(state = 'SUCCESS') AS ok FROM runs GROUP BY 1)
SELECT wallet, runs, CASE WHEN l = 'FAILED' AND NOT ok THEN 'failed' WHEN l = 'RUNNING' AND NOT ok THEN 'syncing' WHEN l = 'RUNNING' AND ok THEN 'syncing-again' WHEN ok THEN 'ready' ELSE 'waiting' END AS onboarding FROM g""")
def onboarding_status(spark, sf):
    return reports.onboarding(_runs(spark, sf))


@_query(f"""WITH r AS (SELECT o_custkey AS wallet, {_DAY.format("o_orderdate")}::BIGINT AS f, {_DAY.format("o_orderdate")}::BIGINT + o_orderkey % 90 AS t FROM orders),
b AS (SELECT *, max(t) OVER (PARTITION BY wallet ORDER BY f, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM r),
i AS (SELECT *, sum(CASE WHEN p IS NULL OR f > p + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY wallet ORDER BY f, t ROWS UNBOUNDED PRECEDING) AS k FROM b)
SELECT wallet, min(f) AS from_block, max(t) AS to_block, count(*) AS merged FROM i GROUP BY wallet, k""")
def cursor_merge(spark, sf):
    day = _day("o_orderdate").cast("long")
    ranges = read(spark, sf, "orders").select(F.col("o_custkey").alias("wallet"), day.alias("from_block"), (day + F.col("o_orderkey") % 90).alias("to_block"))
    return quality.merge_cursors(ranges, ["wallet"])


@_query("""WITH s AS (SELECT s_suppkey AS k, s_suppkey * 1000 AS f, s_suppkey * 1000 + s_suppkey * 37 % 900 AS t FROM supplier)
SELECT k, f AS from_block, t AS to_block, unnest(generate_series(f, t, 100)) AS low, least(low + 99, t) AS high FROM s""")
def block_windows(spark, sf):
    s = F.col("s_suppkey")
    spans = read(spark, sf, "supplier").select(s.alias("k"), (s * 1000).alias("from_block"), (s * 1000 + s * 37 % 900).alias("to_block"))
    return quality.block_windows(spans, 100)


@_query("SELECT l_orderkey, l_linenumber, count(*) AS times FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def dup_checks(spark, sf):
    return quality.duplicates(read(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@_query("""WITH g AS (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1)
SELECT CASE WHEN n IS NULL THEN 'none' WHEN n = 1 THEN 'one' ELSE 'many' END AS backing, count(*) AS transfers FROM orders LEFT JOIN g ON o_orderkey = l_orderkey GROUP BY 1""")
def backing_log_classes(spark, sf):
    logs = read(spark, sf, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("o_orderkey"))
    return quality.backing_logs(read(spark, sf, "orders").select("o_orderkey"), logs, ["o_orderkey"]).groupBy("backing").agg(F.count("*").alias("transfers"))


@_query(_LP + """, st AS (SELECT o_orderkey AS tx, CASE WHEN o_custkey % 2 = 0 THEN 'LP_ADD' ELSE 'LP_REMOVE' END AS k FROM orders)
SELECT CASE WHEN kind IS NULL THEN 'unresolved' WHEN kind = k THEN 'verified' ELSE 'changed' END AS outcome, count(*) AS actions FROM st LEFT JOIN lp USING (tx) GROUP BY 1""")
def provenance_recompute(spark, sf):
    stored = read(spark, sf, "orders").select(F.col("o_orderkey").alias("tx"), F.when(F.col("o_custkey") % 2 == 0, "LP_ADD").otherwise("LP_REMOVE").alias("kind"))
    return quality.provenance(stored, shapes.lp_shape(_transfers(spark, sf))).groupBy("outcome").agg(F.count("*").alias("actions"))


_ACTS = "a AS (SELECT o_custkey AS wallet, o_orderkey % 3 AS stake, o_orderkey AS block, o_orderkey % 7 AS action_index, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 100 END AS locked_day, CASE WHEN o_orderkey % 4 > 0 THEN o_custkey::VARCHAR ELSE 'x' END AS shares, o_orderstatus = 'F' AS fin FROM orders)"


def _stake_actions(spark, sf):
    k = F.col("o_orderkey")
    return read(spark, sf, "orders").select(
        F.col("o_custkey").alias("wallet"), (k % 3).alias("stake"), k.alias("block"), (k % 7).alias("action_index"), F.when(k % 5 > 0, k % 100).alias("locked_day"),
        F.when(k % 4 > 0, F.col("o_custkey").cast("string")).otherwise("x").alias("shares"), (F.col("o_orderstatus") == "F").alias("fin"),
    )


@_query(f"""WITH {_ACTS}, s AS (SELECT * FROM a WHERE NOT fin QUALIFY row_number() OVER (PARTITION BY wallet, stake ORDER BY block DESC, action_index DESC) = 1)
SELECT e.wallet, e.stake, e.block AS end_block, s.block AS start_block, s.locked_day IS NOT NULL AND coalesce(regexp_matches(s.shares, '^[0-9]+$'), false) AS complete FROM a e LEFT JOIN s ON e.wallet = s.wallet AND e.stake = s.stake WHERE e.fin""")
def ended_stake_match(spark, sf):
    a = _stake_actions(spark, sf)
    return staking.match_ends(a.where("fin"), a.where("not fin"))


@_query("""WITH o AS (SELECT o_orderkey AS stake, o_custkey % 10 AS b, o_orderkey % 2 = 0 AS c FROM orders WHERE o_orderkey % 3 <> 0), n AS (SELECT o_orderkey AS stake, (o_custkey + (o_orderkey % 7 = 0)::INT) % 10 AS b, o_orderkey % 4 <> 1 AS c FROM orders WHERE o_orderkey % 5 <> 0)
SELECT CASE WHEN o.stake IS NULL THEN 'created' WHEN n.stake IS NULL THEN 'kept' WHEN o.b <> n.b THEN 'conflict' WHEN NOT o.c AND n.c THEN 'updated' ELSE 'no-op' END AS action, count(*) AS stakes FROM o FULL JOIN n ON o.stake = n.stake GROUP BY 1""")
def ended_stake_upsert(spark, sf):
    rows, k = read(spark, sf, "orders"), F.col("o_orderkey")
    old = rows.where(k % 3 != 0).select(k.alias("stake"), (F.col("o_custkey") % 10).alias("end_block"), (k % 2 == 0).alias("complete"))
    new = rows.where(k % 5 != 0).select(k.alias("stake"), ((F.col("o_custkey") + F.when(k % 7 == 0, 1).otherwise(0)) % 10).alias("end_block"), (k % 4 != 1).alias("complete"))
    return staking.upsert_ended(old, new).groupBy("action").agg(F.count("*").alias("stakes"))


def _events(spark, sf):
    return read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@_query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS events, sum(value::DECIMAL(18,4))::DOUBLE AS value FROM events GROUP BY ALL")
def events_tumbling(spark, sf):
    return windows.tumbling(_events(spark, sf)).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "events", "value")


@_query("""WITH b AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM b)
SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS events FROM s GROUP BY user_id, k""")
def events_session(spark, sf):
    return windows.sessions(_events(spark, sf)).select("user_id", F.unix_micros("start").alias("start_us"), "events")


@_query("SELECT DISTINCT user_id, event_type FROM events")
def events_dedupe(spark, sf):
    return windows.first_seen(_events(spark, sf), ["user_id", "event_type"]).select("user_id", "event_type")


from . import evidence as _evidence_queries  # noqa: E402, F401  the modules register their queries
from . import states as _states_queries  # noqa: E402, F401
from . import accounting as _accounting_queries  # noqa: E402, F401
from . import incremental as _incremental_queries  # noqa: E402, F401
from . import families as _families_queries  # noqa: E402, F401

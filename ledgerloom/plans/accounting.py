"""Average-cost accounting by action group over the trade tables, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import accounting
from ..sources.tables import read, tasks
from .queries import _query

#: An order is a transaction of a nation's wallet, its lines legs of up to three groups; prices hold for all time but one brand has none.
ENTRIES = """e AS (
  SELECT c_nationkey AS wallet, p_brand AS asset, l_orderkey || '-' || l_linenumber % 3 AS group_id, l_orderkey AS tx, l_orderkey::VARCHAR || '/' || lpad(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)::VARCHAR, 2, '0') AS id,
    ['SWAP', 'TRANSFER', 'SWAP', 'TRANSFER', 'SWAP', 'LP_ADD', 'HEX_STAKE_START', 'TRANSFER', 'SWAP', 'TRANSFER', 'SWAP'][l_orderkey % 11 + 1] AS action, l_returnflag = 'R' AS out, l_quantity AS q, o_orderdate AS occ, l_partkey % 9 = 0 AS fee, l_partkey % 31 = 1 AS internal
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
t AS (SELECT *, CASE WHEN fee OR out THEN 'OUT' ELSE 'IN' END AS d, CASE WHEN fee THEN 'FEE' WHEN internal THEN 'INTERNAL_TRANSFER' WHEN action = 'SWAP' THEN CASE WHEN out THEN 'SWAP_OUT' ELSE 'SWAP_IN' END WHEN action = 'TRANSFER' THEN CASE WHEN out THEN 'SEND' ELSE 'RECEIVE' END ELSE action || CASE WHEN out THEN '_OUT' ELSE '_IN' END END AS ty,
  CASE WHEN asset <> 'Brand#55' THEN substr(asset, 7)::INT / 4.0 END AS price FROM e)"""


def entries(spark, sf) -> DataFrame:
    """Entries dealt out by transaction, to as many tasks as the lines ask for; orders meet their customers before their lines."""
    from pyspark.sql import Window

    placed = read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate").join(read(spark, sf, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    line = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_returnflag")
    line = line.join(read(spark, sf, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).repartition(tasks(spark, sf, "lineitem"), "l_orderkey")
    li = line.join(placed, F.col("l_orderkey") == F.col("o_orderkey"))
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"))
    kinds = F.array(*(F.lit(k) for k in ("SWAP", "TRANSFER", "SWAP", "TRANSFER", "SWAP", "LP_ADD", "HEX_STAKE_START", "TRANSFER", "SWAP", "TRANSFER", "SWAP")))
    out, fee, action = F.col("l_returnflag") == "R", F.col("l_partkey") % 9 == 0, F.col("action_type")
    side = lambda a, b: F.when(out, a).otherwise(b)
    kind = F.when(fee, "FEE").when(F.col("l_partkey") % 31 == 1, "INTERNAL_TRANSFER").when(action == "SWAP", side("SWAP_OUT", "SWAP_IN")).when(action == "TRANSFER", side("SEND", "RECEIVE")).otherwise(F.concat(action, side("_OUT", "_IN")))
    rows = li.withColumn("n", n).withColumn("action_type", F.element_at(kinds, (F.col("l_orderkey") % 11 + 1).cast("int")))
    return rows.select(
        F.col("c_nationkey").alias("wallet"), F.col("p_brand").alias("asset"), F.concat_ws("-", "l_orderkey", (F.col("l_linenumber") % 3)).alias("group_id"), F.col("l_orderkey").alias("tx"),
        F.concat_ws("/", "l_orderkey", F.lpad(F.col("n").cast("string"), 2, "0")).alias("id"), "action_type", kind.alias("entry_type"), F.when(fee | out, "OUT").otherwise("IN").alias("direction"),
        F.col("l_quantity").cast("decimal(38,18)").alias("quantity"), F.col("o_orderdate").alias("occurred_at"),
    )


def _price(asset):
    return F.when(asset != "Brand#55", F.substr(asset, F.lit(7)).cast("int") / F.lit(4.0)).cast("decimal(38,18)")


_STEPS = f"""WITH RECURSIVE {ENTRIES},
g AS (SELECT wallet, group_id, min(struct_pack(a := occ, i := id)) AS first, bool_or(action = 'LP_ADD') AS lp, bool_or(action = 'HEX_STAKE_START') AS st, min(action) AS action, min(tx) AS tx FROM t GROUP BY ALL),
o AS (SELECT wallet, group_id, asset, bool_and(ty = 'INTERNAL_TRANSFER') AS internal, coalesce(sum(q) FILTER (WHERE ty IN ('RECEIVE', 'SWAP_IN')), 0) AS qi, count(*) FILTER (WHERE ty IN ('RECEIVE', 'SWAP_IN')) AS ni, coalesce(sum(q) FILTER (WHERE ty IN ('SEND', 'SWAP_OUT')), 0) AS qo,
  count(*) FILTER (WHERE ty IN ('SEND', 'SWAP_OUT')) AS no, coalesce(sum(q) FILTER (WHERE ty = 'FEE'), 0) AS qf, count(*) FILTER (WHERE ty = 'FEE') AS nf FROM t GROUP BY ALL),
k AS (SELECT *, CASE WHEN lp THEN 'UNSUPPORTED_LP_ACTION' WHEN st THEN 'UNSUPPORTED_STAKE_ACTION' END AS blocked, CASE WHEN lp OR st THEN NULL WHEN ni > 0 AND no = 0 AND nf = 0 THEN 'acquire' WHEN no > 0 AND ni = 0 THEN 'dispose' END AS kind FROM o JOIN g USING (wallet, group_id) WHERE lp OR st OR NOT internal),
s AS (SELECT k.*, x.* FROM k, LATERAL (SELECT count(*) FILTER (WHERE ty NOT IN ('FEE', 'INTERNAL_TRANSFER') AND d = CASE kind WHEN 'acquire' THEN 'OUT' ELSE 'IN' END) AS n, coalesce(sum(q * price) FILTER (WHERE ty NOT IN ('FEE', 'INTERNAL_TRANSFER') AND d = CASE kind WHEN 'acquire' THEN 'OUT' ELSE 'IN' END), 0) AS v,
    coalesce(sum(q * price) FILTER (WHERE ty = 'FEE'), 0) AS f, bool_or(price IS NULL AND (ty = 'FEE' OR (ty <> 'INTERNAL_TRANSFER' AND d = CASE kind WHEN 'acquire' THEN 'OUT' ELSE 'IN' END))) AS gap
    FROM t WHERE t.wallet = k.wallet AND t.group_id = k.group_id AND t.asset <> k.asset) x),
step AS (SELECT *, CASE WHEN blocked IS NOT NULL THEN blocked WHEN kind IS NULL THEN 'UNSUPPORTED_ACTION_GROUP' WHEN n = 0 AND action = 'TRANSFER' AND EXISTS (SELECT 1 FROM t WHERE t.wallet = s.wallet AND t.tx = s.tx AND t.group_id <> s.group_id AND t.asset <> s.asset AND ty <> 'FEE' AND q <> 0 AND d = CASE s.kind WHEN 'acquire' THEN 'OUT' ELSE 'IN' END)
    THEN 'UNRESOLVED_ECONOMIC_COUPLING' WHEN coalesce(gap, FALSE) THEN 'COUNTER_ASSET_PRICE_UNAVAILABLE' END AS code, CASE kind WHEN 'acquire' THEN qi WHEN 'dispose' THEN qo + qf END AS q FROM s)
"""


def _steps(spark, sf) -> DataFrame:
    return accounting.group_steps(entries(spark, sf), lambda legs: legs.withColumn("price", _price(F.col("asset"))), dealt=True)


#: Page views as observations of the brands on a chain, in two quotes, over the years of the trades; the last go stale before the last trades.
SERIES = """obs AS (SELECT event_id AS id, 'Brand#' || (user_id % 5 + 1) || (user_id // 5 % 5 + 1) AS asset, floor(value * 100)::BIGINT / 100.0 AS price, ['ONCHAIN_POOL', 'ONCHAIN_ROUTE', 'ORACLE', 'MANUAL', 'DEXSCREENER'][event_id % 5 + 1] AS source_type, (event_id % 100) / 100 AS confidence,
  TIMESTAMP '1992-01-01' + to_days((event_id * 7919 % 1900)::INT) AS observed_at, CASE WHEN event_id % 13 = 0 THEN 'chain:369:erc20:0xown' ELSE 'fiat:usd' END AS quote,
  CASE WHEN event_id % 7 = 0 THEN 'pulsex:pulsex_v2:route:x' WHEN event_id % 11 = 0 THEN 'pulsex:pdai:par' ELSE 'x' END AS source_id FROM events WHERE event_type = 'view'),
fit AS (SELECT * FROM obs WHERE quote = 'fiat:usd' AND source_type <> 'DEXSCREENER' AND source_id = 'x' AND confidence >= 0.5),
need AS (SELECT DISTINCT asset, occ FROM e UNION SELECT DISTINCT asset, TIMESTAMP '1997-03-01' FROM e),
m AS (SELECT need.asset, occ, price FROM need JOIN fit ON need.asset = fit.asset AND observed_at + INTERVAL 60 DAY >= occ
  QUALIFY row_number() OVER (PARTITION BY need.asset, occ ORDER BY CASE source_type WHEN 'ONCHAIN_POOL' THEN 5 WHEN 'ONCHAIN_ROUTE' THEN 4 WHEN 'ORACLE' THEN 3 ELSE 2 END DESC, confidence DESC, observed_at DESC, id) = 1)"""


def observations(spark, sf) -> DataFrame:
    names = F.array(*(F.lit(k) for k in ("ONCHAIN_POOL", "ONCHAIN_ROUTE", "ORACLE", "MANUAL", "DEXSCREENER")))
    k, user = F.col("event_id"), F.col("user_id")
    day = (k * 7919 % 1900).cast("int")
    return read(spark, sf, "events").where("event_type = 'view'").select(
        k.alias("price_id"), F.lit(369).alias("chain_id"), F.concat(F.lit("Brand#"), user % 5 + 1, F.floor(user / 5) % 5 + 1).alias("asset"), (F.floor(F.col("value") * 100).cast("decimal(18,0)") / 100).cast("decimal(18,2)").alias("price"),
        F.element_at(names, (k % 5 + 1).cast("int")).alias("source_type"), (k % 100 / 100).alias("confidence"), F.date_add(F.lit("1992-01-01").cast("date"), day).cast("timestamp").alias("observed_at"), F.lit(60 * 86_400).alias("stale_after_seconds"),
        F.when(k % 13 == 0, "chain:369:erc20:0xown").otherwise("fiat:usd").alias("quote"), F.when(k % 7 == 0, "pulsex:pulsex_v2:route:x").when(k % 11 == 0, "pulsex:pdai:par").otherwise("x").alias("source_id"),
    )


@_query(_STEPS + "SELECT wallet, asset, kind, code, count(*) AS steps, round(sum(q), 4) AS quantity, round(sum(CASE WHEN kind IS NULL THEN 0 ELSE v END)::DOUBLE, 4) AS value, round(sum(CASE WHEN kind IS NULL THEN 0 ELSE f END)::DOUBLE, 4) AS fees FROM step GROUP BY ALL")
def group_steps(spark, sf):
    money = lambda c: F.round(F.sum(c).cast("double"), 4).alias(c)
    return _steps(spark, sf).groupBy("wallet", "asset", "kind", "code").agg(F.count("*").alias("steps"), money("quantity"), money("value"), money("fees"))


_FOLD = """, seq AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY wallet, asset ORDER BY first) AS rn FROM step),
fold AS (SELECT wallet, asset, 0::BIGINT AS rn, 0.0::DOUBLE AS h, 0.0::DOUBLE AS c, 0.0::DOUBLE AS r, 0.0::DOUBLE AS got, 0.0::DOUBLE AS gone, []::VARCHAR[] AS codes FROM seq WHERE rn = 1
  UNION ALL SELECT p.wallet, p.asset, x.rn,
    CASE WHEN x.kind = 'dispose' AND x.q > p.h THEN p.h WHEN x.code IS NOT NULL THEN p.h WHEN x.kind = 'acquire' THEN p.h + x.q ELSE p.h - x.q END,
    CASE WHEN x.kind = 'dispose' AND x.q > p.h THEN p.c WHEN x.code IS NOT NULL THEN p.c WHEN x.kind = 'acquire' THEN p.c + x.v + x.f ELSE p.c - p.c / (CASE WHEN p.h = 0 THEN 1 ELSE p.h END) * x.q END,
    CASE WHEN (x.kind = 'dispose' AND x.q > p.h) OR x.code IS NOT NULL OR x.kind = 'acquire' THEN p.r ELSE p.r + x.v - x.f - p.c / (CASE WHEN p.h = 0 THEN 1 ELSE p.h END) * x.q END,
    CASE WHEN x.code IS NULL AND x.kind = 'acquire' THEN p.got + x.q ELSE p.got END, CASE WHEN x.code IS NULL AND x.kind = 'dispose' AND x.q <= p.h THEN p.gone + x.q ELSE p.gone END,
    list_distinct(p.codes || CASE WHEN x.kind = 'dispose' AND x.q > p.h THEN ['INSUFFICIENT_COST_BASIS'] WHEN x.code IS NOT NULL THEN [x.code] ELSE [] END)
  FROM fold p JOIN seq x ON p.wallet = x.wallet AND p.asset = x.asset AND x.rn = p.rn + 1),
last AS (SELECT * FROM fold QUALIFY row_number() OVER (PARTITION BY wallet, asset ORDER BY rn DESC) = 1)
SELECT wallet, asset, round(h, 4) AS holdings, round(CASE WHEN h > 0 THEN c / h ELSE 0 END, 3) AS average_cost, round(r, 3) AS realized, round((mark - CASE WHEN h > 0 THEN c / h ELSE 0 END) * h, 3) AS unrealized, round(got, 4) AS acquired, round(gone, 4) AS disposed,
  array_to_string(list_sort(codes) || CASE WHEN mark IS NULL THEN ['MARK_PRICE_UNAVAILABLE'] ELSE [] END, ',') AS codes FROM last LEFT JOIN marks USING (asset)"""
_CONSTANT_MARKS = ", marks AS (SELECT DISTINCT asset, 10 AS mark FROM t WHERE asset <> 'Brand#55')"


def _shown(got):
    number = lambda c, n: F.round(F.col(c).cast("double"), n).alias(c)
    return got.select("wallet", "asset", number("holdings", 4), number("average_cost", 3), number("realized", 3), number("unrealized", 3), number("acquired", 4), number("disposed", 4), F.array_join("codes", ",").alias("codes"))


@_query(_STEPS + _CONSTANT_MARKS + _FOLD)
def pnl_action_groups(spark, sf):
    marks = read(spark, sf, "part").select(F.col("p_brand").alias("asset")).distinct().where("asset != 'Brand#55'").withColumn("price", F.lit(10).cast("decimal(38,18)"))
    got = accounting.marked(accounting.folded(_steps(spark, sf)), marks)
    return _shown(got)


_PRICED = _STEPS.replace("t AS (SELECT *,", SERIES + ",\nt AS (SELECT e.*,", 1).replace("CASE WHEN asset <> 'Brand#55' THEN substr(asset, 7)::INT / 4.0 END AS price FROM e)", "price FROM e LEFT JOIN m USING (asset, occ))", 1)


@_query(_PRICED + ", marks AS (SELECT asset, price AS mark FROM m WHERE occ = TIMESTAMP '1997-03-01')" + _FOLD)
def pnl_priced(spark, sf):
    """Profit with all legs and marks priced from the stored series, by chain, asset and quote."""
    rows = entries(spark, sf).withColumn("chain_id", F.lit(369)).withColumn("occurred_at", F.col("occurred_at").cast("timestamp"))
    return _shown(accounting.priced_profit(rows, observations(spark, sf), F.lit("1997-03-01").cast("timestamp"), "fiat:usd", own_quote="chain:369:erc20:0xown", width_s=30 * 86_400, dealt=True))

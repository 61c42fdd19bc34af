"""Queries over statuses, observations and scalars of the ledger, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..functions import states as st
from ..operators import observations as ob
from ..sources.tables import read
from .evidence import _DAYS, days
from .queries import _query

_DAY = "date_diff('day', DATE '1992-01-01', o_orderdate::DATE)"


def _o(spark, sf):
    o = read(spark, sf, "orders")
    return o.withColumns({"k": F.col("o_orderkey"), "day": F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01").cast("date"))})


_O = f"o AS (SELECT *, o_orderkey AS k, {_DAY} AS day FROM orders)"


@_query(f"WITH {_O}, b AS (SELECT CASE WHEN k % 10 = 0 THEN 1 ELSE 369 END AS chain, CASE WHEN k % 9 = 0 THEN -k ELSE 17232000 + k % 2000 END AS block FROM o) SELECT CASE WHEN chain <> 369 OR block < 0 THEN 'UNKNOWN_OR_UNVERIFIED' WHEN block < 17233000 THEN 'ETHEREUM_INHERITED_HISTORY' ELSE 'PULSECHAIN_POST_FORK' END AS provenance, count(*) AS blocks FROM b GROUP BY ALL")
def fork_provenance(spark, sf):
    k = F.col("k")
    got = st.fork_provenance(F.when(k % 10 == 0, 1).otherwise(369), F.when(k % 9 == 0, -k).otherwise(17232000 + k % 2000))
    return _o(spark, sf).groupBy(got.alias("provenance")).agg(F.count("*").alias("blocks"))


@_query(f"""WITH {_O}, a AS (SELECT k, CASE k % 6 WHEN 0 THEN 'PLS' WHEN 1 THEN 'chain:1:erc20:0x' || lpad(k::VARCHAR, 40, '0') WHEN 2 THEN 'chain:369:native:0x' || lpad((k % 12 - 2)::VARCHAR, 40, '0') ELSE 'chain:369:erc20:0x' || lpad(k::VARCHAR, 40, '0') END AS asset,
CASE k % 6 WHEN 3 THEN NULL WHEN 4 THEN '0x' || lpad((k + 1)::VARCHAR, 40, '0') ELSE '0x' || lpad(k::VARCHAR, 40, '0') END AS address FROM o)
SELECT CASE k % 6 WHEN 0 THEN 'malformed' WHEN 1 THEN 'other-chain' WHEN 2 THEN CASE WHEN k % 12 = 2 THEN NULL ELSE 'not-the-native-asset' END WHEN 3 THEN 'no-address' WHEN 4 THEN 'other-address' END AS fault, count(*) AS assets FROM a GROUP BY ALL""")
def identity_faults_of_assets(spark, sf):
    k = F.col("k")
    address = lambda c: F.concat(F.lit("0x"), F.lpad(c.cast("string"), 40, "0"))
    asset = F.when(k % 6 == 0, "PLS").when(k % 6 == 1, F.concat(F.lit("chain:1:erc20:"), address(k))).when(k % 6 == 2, F.concat(F.lit("chain:369:native:"), address(k % 12 - 2))).otherwise(F.concat(F.lit("chain:369:erc20:"), address(k)))
    held = F.when(k % 6 == 3, F.lit(None).cast("string")).when(k % 6 == 4, address(k + 1)).otherwise(F.upper(address(k)))
    got = _o(spark, sf).select(st.identity_fault(asset, F.lit(369), F.lower(held)).alias("fault"))
    return got.groupBy("fault").agg(F.count("*").alias("assets"))


@_query(f"""WITH {_O}, p AS (SELECT k % 4 AS a, k % 3 AS b FROM o) SELECT CASE a WHEN 0 THEN 'pulsex:pdai:par' WHEN 1 THEN 'pulsex:pulsex_v1:route:x' WHEN 2 THEN 'pulsex:pulsex_v2:route:y' ELSE 'oracle:z' END AS source_id, b = 0 AS own,
a = 0 OR (a IN (1, 2) AND b <> 0) AS unverified, count(*) AS prices FROM p GROUP BY ALL""")
def quote_eligibility(spark, sf):
    k = F.col("k")
    source = F.when(k % 4 == 0, st.PAR_SOURCE).when(k % 4 == 1, "pulsex:pulsex_v1:route:x").when(k % 4 == 2, "pulsex:pulsex_v2:route:y").otherwise("oracle:z")
    rows = _o(spark, sf).select(source.alias("source_id"), F.when(k % 3 == 0, "Chain:369:ERC20:0xDAI").otherwise("fiat:usd").alias("quote"))
    rows = rows.select("source_id", (F.lower("quote") == "chain:369:erc20:0xdai").alias("own"), st.quote_unverified(F.col("source_id"), F.col("quote"), "chain:369:erc20:0xdai").alias("unverified"))
    return rows.groupBy("source_id", "own", "unverified").agg(F.count("*").alias("prices"))


_STAKES = f"""{_O}, s AS (SELECT k AS stake, o_custkey AS wallet, CASE WHEN k % 19 = 0 THEN 1 ELSE 369 END AS chain_id, CASE WHEN k % 17 = 0 THEN 0 ELSE (o_custkey * 1000003) END AS shares, day AS locked_day, (k % 40 + 1)::INT AS staked_days FROM o)"""


def _stakes(spark, sf):
    k = F.col("k")
    return _o(spark, sf).select(k.alias("stake"), F.col("o_custkey").alias("wallet"), F.when(k % 19 == 0, 1).otherwise(369).alias("chain_id"), F.when(k % 17 == 0, 0).otherwise(F.col("o_custkey") * 1000003).alias("shares"), F.col("day").alias("locked_day"), (k % 40 + 1).cast("int").alias("staked_days"))


@_query(f"""WITH {_STAKES} SELECT CASE WHEN stake % 23 = 0 THEN 'unknown' WHEN locked_day > 1200 THEN 'pending' WHEN 1200 >= locked_day + staked_days THEN 'overdue' ELSE 'active' END AS status,
locked_day <= 353 AND locked_day + staked_days > 353 AS pays, chain_id = 369 AND stake % 5 > 0 AND locked_day <= 1200 AND 1200 < locked_day + staked_days AS active, count(*) AS stakes FROM s GROUP BY ALL""")
def stake_states(spark, sf):
    now = F.when(F.col("stake") % 23 == 0, F.lit(None).cast("int")).otherwise(1200)
    d, n = F.col("locked_day"), F.col("staked_days")
    own = st.active_stake(F.col("chain_id"), F.lit("native"), F.when(F.col("stake") % 5 == 0, "ended").otherwise("open"), d, n, F.lit(1200))
    got = _stakes(spark, sf).select(st.stake_status(now, d, n).alias("status"), (st.extra_pay(d, n, F.lit(False)) == "applicable").alias("pays"), own.alias("active"))
    return got.groupBy("status", "pays", "active").agg(F.count("*").alias("stakes"))


@_query("""WITH o AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders)
SELECT k, (c * 12345 // 100000000) || '.' || lpad((c * 12345 % 100000000)::VARCHAR, 8, '0') AS principal, (c // 8) || CASE c % 8 WHEN 0 THEN '' WHEN 1 THEN '.125' WHEN 2 THEN '.25' WHEN 3 THEN '.375' WHEN 4 THEN '.5' WHEN 5 THEN '.625' WHEN 6 THEN '.75' ELSE '.875' END AS shares,
(c * 1000000007 * 21000)::VARCHAR AS fee, CASE WHEN k % 7 = 0 THEN NULL ELSE (c // 4) || CASE c % 4 WHEN 0 THEN '' WHEN 1 THEN '.25' WHEN 2 THEN '.5' ELSE '.75' END END AS shown FROM o""")
def unit_texts(spark, sf):
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    units = F.when(k % 7 == 0, "x").otherwise((c * 25_000_000).cast("string"))
    return read(spark, sf, "orders").select(k.alias("k"), st.principal_text(c * 12345).alias("principal"), st.share_text(c.cast("decimal(20,0)") * F.lit(125_000_000_000).cast("decimal(12,0)")).alias("shares"), st.gas_fee(c * 1000000007, F.lit(21000)).cast("string").alias("fee"), st.display_units(units).alias("shown"))


@_query("""SELECT o_orderkey AS k, round(o_custkey / 1000.0, 3)::DOUBLE AS price, round(o_custkey * (o_custkey / 1000.0) * 2, 3)::DOUBLE AS liquidity, (o_custkey * 10 + 5)::VARCHAR || repeat('0', 16) AS scaled FROM orders""")
def pool_values(spark, sf):
    c = F.col("o_custkey")
    price = st.pool_price(F.concat(c.cast("string"), F.lit("0" * 15)))
    scaled = st.scaled18(F.concat((c / 10).cast("decimal(20,1)").cast("string"), F.lit("5")))
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.round(price.cast("double"), 3).alias("price"), F.round(st.pool_liquidity(c * 1000000, F.lit(6), price), 3).alias("liquidity"), scaled.cast("string").alias("scaled"))


@_query(f"""WITH {_O}, r AS (SELECT k, CASE WHEN k % 5 > 0 THEN k END AS lo, CASE WHEN k % 3 > 0 THEN k + 9 END AS hi FROM o) SELECT CASE WHEN lo IS NOT NULL AND hi IS NOT NULL THEN 'covered' WHEN lo IS NOT NULL OR hi IS NOT NULL THEN 'partial' ELSE 'unknown' END AS status, count(*) AS wallets FROM r GROUP BY ALL""")
def ledger_coverage(spark, sf):
    k = F.col("k")
    got = st.coverage_status(F.when(k % 5 > 0, k), F.when(k % 3 > 0, k + 9))
    return _o(spark, sf).groupBy(got.alias("status")).agg(F.count("*").alias("wallets"))


_CODED = f"""{_O}, c AS (SELECT k, list_filter([CASE WHEN k % 7 = 0 THEN 'INSUFFICIENT_COST_BASIS' END, CASE WHEN k % 5 = 0 THEN 'UNSUPPORTED_LP_ACTION' END, CASE WHEN k % 3 = 0 THEN 'MARK_PRICE_UNAVAILABLE' END], lambda x: x IS NOT NULL) AS codes,
  list_filter([CASE WHEN k % 4 = 0 THEN 'STALE' END, CASE WHEN k % 6 = 0 THEN 'LOW_CONFIDENCE' END, CASE WHEN k % 10 = 0 THEN 'SOURCE_DISABLED' END], lambda x: x IS NOT NULL) AS rejected, k % 2 = 1 AS priced FROM o),
d AS (SELECT *, CASE WHEN priced THEN 'available' WHEN list_contains(rejected, 'STALE') THEN 'stale_price' WHEN list_contains(rejected, 'LOW_CONFIDENCE') THEN 'low_confidence_price' ELSE 'unavailable' END AS pricing FROM c),
f AS (SELECT *, CASE WHEN k % 7 = 0 THEN 'incomplete_basis' WHEN k % 5 = 0 THEN 'unsupported' WHEN k % 3 = 0 THEN CASE WHEN pricing IN ('stale_price', 'low_confidence_price') THEN pricing ELSE 'unavailable' END ELSE 'available' END AS pnl FROM d)"""


def _coded(spark, sf):
    k = F.col("k")
    pick = lambda **w: F.array_compact(F.array(*(F.when(k % n == 0, c) for c, n in w.items())))
    rows = _o(spark, sf).select("k", "o_custkey", pick(INSUFFICIENT_COST_BASIS=7, UNSUPPORTED_LP_ACTION=5, MARK_PRICE_UNAVAILABLE=3).alias("codes"), pick(STALE=4, LOW_CONFIDENCE=6, SOURCE_DISABLED=10).alias("rejected"), F.when(k % 2 == 1, k).alias("selected"))
    rows = rows.withColumn("pricing", st.pricing_status(F.col("selected"), F.col("rejected")))
    return rows.withColumn("pnl", st.pnl_status(F.col("codes"), F.col("pricing")))


@_query(f"WITH {_CODED} SELECT pricing, pnl, count(*) AS positions FROM f GROUP BY ALL")
def position_statuses(spark, sf):
    return _coded(spark, sf).groupBy("pricing", "pnl").agg(F.count("*").alias("positions"))


@_query(f"""WITH {_CODED}, g AS (SELECT f.k % 60 AS wallet, CASE f.k % 9 WHEN 7 THEN 'lpPositions' WHEN 8 THEN 'stakePositions' ELSE 'tokens' END AS section, pnl, pricing, codes, rejected FROM f),
x AS (SELECT wallet, section, section = 'tokens' AND pnl = 'available' AS priced, section = 'tokens' AND (pnl = 'unavailable' OR list_contains(codes, 'MARK_PRICE_UNAVAILABLE') OR pricing IN ('unavailable', 'low_confidence_price')) AS u,
 section = 'tokens' AND (pnl = 'incomplete_basis' OR list_contains(codes, 'INSUFFICIENT_COST_BASIS')) AS b, pnl = 'unsupported' AS t, section = 'tokens' AND (pnl = 'stale_price' OR pricing = 'stale_price' OR list_contains(rejected, 'STALE')) AS s, section = 'tokens' AND list_contains(rejected, 'SOURCE_DISABLED') AS d FROM g),
n AS (SELECT wallet, count(*) AS positions, count(*) FILTER (WHERE priced) AS priced, count(*) FILTER (WHERE u) AS unpriced, count(*) FILTER (WHERE b) AS insufficient_cost_basis, count(*) FILTER (WHERE t) AS unsupported_position_type, count(*) FILTER (WHERE s) AS stale_price,
 count(*) FILTER (WHERE d) AS source_disabled, bool_or(section = 'tokens' AND (u OR b OR t OR s OR d)) AS tk, bool_or(section = 'lpPositions' AND t) AS lp, bool_or(section = 'stakePositions' AND t) AS sp FROM x GROUP BY wallet)
SELECT wallet, positions, priced, unpriced, insufficient_cost_basis, unsupported_position_type, stale_price, source_disabled,
 concat_ws(',', CASE WHEN unpriced > 0 THEN 'unpriced' END, CASE WHEN insufficient_cost_basis > 0 THEN 'insufficient_cost_basis' END, CASE WHEN unsupported_position_type > 0 THEN 'unsupported_position_type' END, CASE WHEN stale_price > 0 THEN 'stale_price' END, CASE WHEN source_disabled > 0 THEN 'source_disabled' END) AS reasons,
 concat_ws(',', CASE WHEN tk OR lp OR sp THEN 'summary' END, CASE WHEN tk THEN 'tokens' END, CASE WHEN lp THEN 'lpPositions' END, CASE WHEN sp THEN 'stakePositions' END) AS sections,
 CASE WHEN NOT (tk OR lp OR sp) THEN 'valued' WHEN unsupported_position_type = positions THEN 'unsupported' WHEN priced > 0 THEN 'partial' ELSE 'unavailable' END AS status FROM n""")
def pnl_coverage(spark, sf):
    k = F.col("k")
    section = F.when(k % 9 == 7, "lpPositions").when(k % 9 == 8, "stakePositions").otherwise("tokens")
    return ob.pnl_coverage(_coded(spark, sf).withColumns({"wallet": k % 60, "section": section}))


@_query("""SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'materialization_warning' ELSE 'negative_token_balance' END AS code, CASE WHEN o_orderkey % 3 > 0 THEN 'chain:369:erc20:0x' || o_custkey END AS asset, CASE WHEN o_orderkey % 3 > 0 THEN '-' || o_orderkey || '.5' END AS quantity,
CASE WHEN o_orderkey % 4 > 0 THEN 'priced' ELSE 'unavailable' END AS pricing_status, CASE WHEN o_orderkey % 4 > 0 THEN 'valued' ELSE 'unavailable' END AS valuation_status, CASE WHEN o_orderkey % 4 > 0 THEN 'fiat:usd' END AS quote_asset FROM orders""")
def parsed_warnings(spark, sf):
    k = F.col("o_orderkey")
    text = F.when(k % 3 == 0, F.concat(F.lit("lp-position-missing-lp-leg:"), k.cast("string"))).otherwise(F.concat(F.lit("negative-token-balance:chain:369:erc20:0x"), F.col("o_custkey").cast("string"), F.lit(":-"), k.cast("string"), F.lit(".5")))
    return read(spark, sf, "orders").select(k.alias("k"), st.parsed_warning(text).alias("w"), *st.entry_flags(F.when(k % 4 > 0, F.col("o_totalprice")))).select("k", "w.*", "pricing_status", "valuation_status", "quote_asset")


_MESSAGES = ["Rate limit hit", "request timed out", "ECONNREFUSED", "Bad Gateway", "invalid JSON", "execution reverted", "block range", "provider disagreement", "no idea"]
_CLASSES = ["rate_limited", "timeout", "network_unreachable", "provider_unavailable", "invalid_response", "execution_reverted", "block_range_too_large", "provider_disagreement", "unknown"]


@_query(f"""WITH m AS (SELECT o_orderkey AS k, {_MESSAGES!r}[o_orderkey % 9 + 1] AS message, CASE WHEN o_orderkey % 11 = 0 THEN 429 WHEN o_orderkey % 13 = 0 THEN 503 END AS code, o_orderkey % 5 AS attempt FROM orders),
c AS (SELECT *, CASE WHEN code = 429 THEN 'rate_limited' WHEN code = 503 AND k % 9 > 2 THEN 'provider_unavailable' ELSE {_CLASSES!r}[k % 9 + 1] END AS failure FROM m)
SELECT failure, CASE WHEN failure = 'unknown' THEN 'unknown_failure_not_retryable' WHEN failure IN ('invalid_response', 'execution_reverted', 'provider_disagreement') THEN 'failure_not_retryable' WHEN attempt >= 3 THEN 'max_attempts_reached' WHEN failure = 'block_range_too_large' THEN failure ELSE 'retryable_failure' END AS decision,
least(250 * 2 ** attempt, 1500)::BIGINT AS delay, count(*) AS errors FROM c GROUP BY ALL""")
def provider_failures(spark, sf):
    k = F.col("o_orderkey")
    message = F.element_at(F.array(*(F.lit(m) for m in _MESSAGES)), (k % 9 + 1).cast("int"))
    code = F.when(k % 11 == 0, 429).when(k % 13 == 0, 503)
    got = read(spark, sf, "orders").select(st.provider_failure(message, code).alias("failure"), (k % 5).alias("attempt"))
    return got.groupBy("failure", st.retry_decision(F.col("failure"), F.col("attempt"), 3).alias("decision"), st.retry_delay(F.col("attempt"), 250, 1500).alias("delay")).agg(F.count("*").alias("errors"))


@_query("""WITH m AS (SELECT o_orderkey AS k, ['ContractFunctionExecutionError', 'Timeout', 'ECONNRESET', 'TypeError'][o_orderkey % 4 + 1] AS name FROM orders)
SELECT k, ['contract_function_execution_error', 'timeout_error', 'network_error', 'unexpected_error'][k % 4 + 1] AS class, 'see [redacted-url] now ' || k AS detail FROM m""")
def sync_errors(spark, sf):
    k = F.col("o_orderkey")
    name = F.element_at(F.array(*(F.lit(n) for n in ("ContractFunctionExecutionError", "Timeout", "ECONNRESET", "TypeError"))), (k % 4 + 1).cast("int"))
    text = F.concat(F.lit("see  https://node.example/key?a=1 \n now "), k.cast("string"), F.lit(" "))
    return read(spark, sf, "orders").select(k.alias("k"), st.sync_error(name, F.lit("at work")).alias("class"), st.redacted(text).alias("detail"))


@_query(f"""WITH c AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders)
SELECT k, CASE k % 4 WHEN 0 THEN 'START' WHEN 1 THEN 'END' WHEN 2 THEN 'missing-input' ELSE 'unsupported-selector' END AS kind, CASE WHEN k % 4 = 0 THEN (c::HUGEINT * 1000000000000)::VARCHAR END AS principal,
CASE WHEN k % 4 = 0 THEN k % 5555 END AS days, CASE WHEN k % 4 = 1 THEN c % 30 END AS stake_index, CASE WHEN k % 4 = 1 THEN k + 700000 END AS stake_id FROM c""")
def stake_calls(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    word = lambda x: F.lpad(F.lower(F.hex(x.cast("long"))), 64, "0")
    data = F.when(k % 4 == 0, F.concat(F.lit("0x52A438B8"), word(c * 1000000000000), word(k % 5555))).when(k % 4 == 1, F.concat(F.lit("0x343009a2"), word(c % 30), word(k + 700000))).when(k % 4 == 2, "0x").otherwise("0xabcdef01")
    got = read(spark, sf, "orders").select(k.alias("k"), st.stake_call(data).alias("call")).select("k", "call.*")
    return got.withColumn("principal", scalars.hex_to_digits("principal"))


@_query("""SELECT o_orderkey AS k, '0x' || lpad(o_custkey::VARCHAR, 40, 'a') AS sender, (o_custkey::HUGEINT * 1000000007)::VARCHAR AS amount, CASE WHEN o_orderkey % 3 = 0 THEN 'Stake:' || o_custkey ELSE NULL END IS NOT NULL AS staked, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey::VARCHAR END AS stake,
o_custkey || '.5' AS quantity, CASE WHEN o_orderkey % 2 = 0 THEN '0x' || lpad(o_custkey::VARCHAR, 40, '0') END AS address FROM orders""")
def decoded_transfers(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    topic = F.concat(F.lit("0x" + "0" * 24), F.upper(F.lpad(c.cast("string"), 40, "a")))
    data = F.lower(F.hex((c * 1000000007).cast("long")))
    source = F.when(k % 3 == 0, F.concat(F.lit("log:0x1:STAKE:start:"), c.cast("string"), F.lit(":2"))).otherwise("log:0x1:transfer")
    asset = F.when(k % 2 == 0, F.concat(F.lit("chain:369:erc20:0x"), F.lpad(c.cast("string"), 40, "0"))).otherwise("chain:369:native:0x0")
    key = scalars.stake_key(source)
    quantity = scalars.trim_decimal(F.concat(scalars.canonical_quantity((c * 10 + 5).cast("string"), F.lit(1)), F.lit("00")))
    return read(spark, sf, "orders").select(k.alias("k"), F.lower(F.concat(F.lit("0x"), F.right(topic, F.lit(40)))).alias("sender"), scalars.hex_to_digits(data).alias("amount"), key.isNotNull().alias("staked"), key.alias("stake"), quantity.alias("quantity"), scalars.asset_address(asset).alias("address"))


_PAYLOADS = ["{bad", '{"schemaVersion":"v1","dailyData":["1",2]}', '["v1"]', '{"dailyData":[]}', '{"schemaVersion":"v2","dailyData":[]}', '{"schemaVersion":"v1"}', '{"schemaVersion":"v1","dailyData":"x"}', '{"schemaVersion":"v1","dailyData":["1",null]}', '{"schemaVersion":"v1","dailyData":["12x"]}', '{"schemaVersion":"v1","dailyData":["0012","5"]}']
_FAULTS = ["invalid-json", "numeric-json-value", "invalid-root", "missing-schema-version", "unsupported-schema-version", "missing-daily-data", "daily-data-not-array", "item-not-string-at-1", "item-invalid-at-0", None]


@_query(f"SELECT o_orderkey AS k, [{', '.join('NULL' if f is None else repr(f) for f in _FAULTS)}][o_orderkey % 10 + 1] AS fault FROM orders")
def payload_faults(spark, sf):
    k = F.col("o_orderkey")
    text = F.element_at(F.array(*(F.lit(p) for p in _PAYLOADS)), (k % 10 + 1).cast("int"))
    return read(spark, sf, "orders").select(k.alias("k"), st.payload_code(text).alias("fault"))


@_query(f"WITH {_DAYS} SELECT day - day % 30 + n AS day, orders, keys::VARCHAR AS shares FROM (SELECT *, row_number() OVER (PARTITION BY day // 30 ORDER BY day) - 1 AS n FROM days)")
def decoded_days(spark, sf):
    from ..operators.evidence import encoded_days
    from ..operators.staking import payload_days

    payloads = encoded_days(days(spark, sf), ["month"]).withColumn("from_day", F.col("month") * 30)
    return payload_days(payloads).select("day", F.col("payout").cast("long").alias("orders"), F.col("shares").alias("shares"))


@_query("""SELECT o_orderkey AS k, replace(CASE WHEN o_custkey % 3 = 0 THEN 'chain:369:native:PLS' ELSE 'chain:369:erc20:' || o_custkey END, 'native:PLS', 'native:0x0') || '|' || o_orderpriority AS items FROM orders""")
def renamed_assets(spark, sf):
    items = F.array(F.when(F.col("o_custkey") % 3 == 0, "chain:369:native:PLS").otherwise(F.concat(F.lit("chain:369:erc20:"), "o_custkey")), F.col("o_orderpriority"))
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.array_join(st.renamed_asset(items, "native:PLS", "native:0x0"), "|").alias("items"))


_BIG = f"""{_STAKES}, {_DAYS}, b AS (SELECT day, keys::HUGEINT * 1000000007 AS payout, CASE WHEN day % 13 = 0 THEN 0 ELSE orders * 999999937 END AS total FROM days)"""


def _big_days(spark, sf):
    wide = lambda c, n: F.col(c).cast("decimal(20,0)") * F.lit(n).cast("decimal(10,0)")
    return days(spark, sf).select("day", wide("keys", 1000000007).alias("payout"), F.when(F.col("day") % 13 == 0, F.lit(0).cast("decimal(31,0)")).otherwise(wide("orders", 999999937)).alias("total_shares"))


_YIELD = f"{_BIG}, y AS (SELECT stake, coalesce(sum(CASE WHEN total > 0 THEN shares::HUGEINT * payout // total END), 0)::VARCHAR AS yield_units, count(b.day) AS entries, staked_days FROM s LEFT JOIN b ON b.day BETWEEN locked_day AND locked_day + staked_days - 1 GROUP BY stake, staked_days)"


@_query(f"WITH {_YIELD} SELECT stake, yield_units FROM y")
def stake_yield_exact(spark, sf):
    return ob.exact_yield(_stakes(spark, sf), _big_days(spark, sf))


@_query(f"WITH {_YIELD} SELECT stake, yield_units FROM y")
def stake_yield_slices(spark, sf):
    return ob.sliced_yield(_stakes(spark, sf), _big_days(spark, sf))


@_query(f"WITH {_YIELD} SELECT stake, CASE WHEN entries <> staked_days THEN 'entry-count-mismatch' WHEN stake % 10 = 0 THEN 'mismatch' ELSE 'match' END AS result FROM y")
def verified_yields(spark, sf):
    claimed = ob.exact_yield(_stakes(spark, sf), _big_days(spark, sf)).withColumn("yield_units", F.when(F.col("stake") % 10 == 0, "-1").otherwise(F.col("yield_units")))
    return ob.verified_yield(_stakes(spark, sf), _big_days(spark, sf), claimed)


_OBS = f"""{_STAKES}, ob AS (SELECT stake AS observation, 369 AS chain_id, locked_day AS f, CASE WHEN stake % 4 = 0 THEN 1199 ELSE least(1199, locked_day + staked_days - 1) END AS t, stake % 100 AS blk, stake % 29 = 0 AS failed, stake % 7 = 0 AS invalidated, stake % 11 > 0 AS valid FROM s WHERE stake % 3 > 0),
newest AS (SELECT * FROM ob QUALIFY row_number() OVER (PARTITION BY f, t ORDER BY blk DESC, observation) = 1)"""


def _observations(spark, sf):
    k, low = F.col("stake"), F.col("locked_day")
    high = F.when(k % 4 == 0, 1199).otherwise(F.least(F.lit(1199), low + F.col("staked_days") - 1))
    rows = _stakes(spark, sf).where("stake % 3 > 0")
    return rows.select(k.alias("observation"), F.lit(369).alias("chain_id"), low.alias("from_day"), high.alias("to_day"), (k % 100).alias("observed_block"), (k % 29 == 0).alias("failed"), (k % 7 == 0).alias("invalidated"), (k % 11 > 0).alias("valid"))


@_query(f"""WITH {_OBS}, e AS (SELECT s.*, n.observation, n.failed, n.invalidated, n.valid, least(1199, locked_day + staked_days - 1) AS fin FROM s LEFT JOIN newest n ON s.chain_id = 369 AND n.f = locked_day AND n.t = least(1199, locked_day + staked_days - 1)),
g AS (SELECT *, CASE WHEN chain_id <> 369 THEN 'unsupported' WHEN shares <= 0 THEN 'invalid_observation' WHEN failed THEN 'unavailable' WHEN observation IS NULL THEN 'insufficient_observations' WHEN invalidated OR NOT valid THEN 'invalid_observation' WHEN 1200 <= locked_day THEN 'insufficient_observations' ELSE 'estimated' END AS status FROM e)
SELECT stake, observation, status, CASE WHEN status = 'estimated' AND locked_day <= 353 AND fin >= 353 THEN 'bpd-attribution-unresolved' END AS warning, CASE WHEN status <> 'estimated' OR (locked_day <= 353 AND fin >= 353) THEN 'unknown' WHEN locked_day <= 353 AND locked_day + staked_days > 353 THEN 'applicable' ELSE 'not_applicable' END AS extra_pay FROM g""")
def yield_estimates(spark, sf):
    return ob.estimates(_stakes(spark, sf), _observations(spark, sf), F.lit(1200))


@_query(f"""WITH {_OBS} SELECT stake, CASE WHEN n.f IS NULL THEN 'missing_exact_observation' WHEN invalidated THEN 'invalidated_observation' WHEN NOT valid THEN 'invalid_observation_payload' END AS reason FROM s LEFT JOIN newest n ON n.f = locked_day AND n.t = 1199 WHERE locked_day <= 1199""")
def evidence_reasons(spark, sf):
    return ob.coverage_report(_stakes(spark, sf), _observations(spark, sf), F.lit(1200))


@_query(f"WITH {_OBS} SELECT 369 AS chain_id, arg_max(observation, {{'b': blk, 'o': observation}}) AS observation, max(blk) AS observed_block FROM ob WHERE NOT invalidated")
def latest_observation(spark, sf):
    o = _observations(spark, sf)
    return ob.latest_valid(o, o.where("invalidated").select("observation"))


_ENDED = "a AS (SELECT o_orderkey AS stake, o_orderkey % 50 AS end_block, '0xAB' || o_custkey AS end_tx, o_orderkey % 3 = 0 AS complete, o_orderkey % 4 AS locked_day, '7' AS shares FROM orders WHERE o_orderkey % 5 > 0), b AS (SELECT o_orderkey AS stake, CASE WHEN o_orderkey % 7 = 0 THEN -1 ELSE o_orderkey % 50 END AS end_block, CASE WHEN o_orderkey % 8 = 0 THEN '0xother' ELSE '0xab' || o_custkey END AS end_tx, o_orderkey % 2 = 0 AS complete, o_orderkey % 6 AS locked_day, '7' AS shares FROM orders WHERE o_orderkey % 9 > 0)"


def _ended(spark, sf):
    o, k, c = read(spark, sf, "orders"), F.col("o_orderkey"), F.col("o_custkey").cast("string")
    a = o.where(k % 5 > 0).select(k.alias("stake"), (k % 50).alias("end_block"), F.concat(F.lit("0xAB"), c).alias("end_tx"), (k % 3 == 0).alias("complete"), (k % 4).alias("locked_day"), F.lit("7").alias("shares"))
    b = o.where(k % 9 > 0).select(k.alias("stake"), F.when(k % 7 == 0, -1).otherwise(k % 50).alias("end_block"), F.when(k % 8 == 0, "0xother").otherwise(F.concat(F.lit("0xab"), c)).alias("end_tx"), (k % 2 == 0).alias("complete"), (k % 6).alias("locked_day"), F.lit("7").alias("shares"))
    return a, b


@_query(f"WITH {_ENDED} SELECT b.stake, CASE WHEN a.stake IS NULL THEN 'created' WHEN a.end_block <> b.end_block OR lower(a.end_tx) <> lower(b.end_tx) THEN 'conflict' WHEN NOT a.complete AND b.complete THEN 'updated' ELSE 'no-op' END AS action FROM b LEFT JOIN a ON a.stake = b.stake")
def ended_stake_actions(spark, sf):
    return ob.upsert_action(*_ended(spark, sf), ["stake"])


@_query(f"WITH {_ENDED} SELECT b.stake, CASE WHEN a.stake IS NULL THEN 'not-found' WHEN a.end_block <> b.end_block THEN 'evidence-changed' WHEN a.complete AND a.locked_day = b.locked_day THEN 'already-complete' WHEN a.complete THEN 'conflict' ELSE 'enriched' END AS outcome FROM b LEFT JOIN a ON a.stake = b.stake")
def stake_enrichment(spark, sf):
    return ob.enrich(*_ended(spark, sf), ["stake"])


@_query("""WITH l AS (SELECT l_suppkey AS wallet, l_partkey AS stake, count(*) AS n, min(l_linenumber) AS d FROM lineitem WHERE l_partkey % 3 > 0 GROUP BY ALL), t AS (SELECT DISTINCT l_suppkey AS wallet, l_partkey AS stake FROM lineitem)
SELECT wallet, stake, CASE WHEN n IS NULL THEN 'no_match' WHEN n > 1 THEN 'multiple_match' ELSE 'recovered' END AS code FROM t LEFT JOIN l USING (wallet, stake)""")
def recovered_stakes(spark, sf):
    li = read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("wallet"), F.col("l_partkey").alias("stake"), F.col("l_linenumber").alias("locked_day"), F.col("l_quantity").cast("long").alias("shares"))
    return ob.recover(li.select("wallet", "stake").distinct(), li.where("stake % 3 > 0"))


@_query("""SELECT p_partkey AS token, CASE WHEN p_size % 5 = 0 THEN 'skipped_already_complete' WHEN p_partkey % 7 = 0 OR p_partkey % 3 = 0 OR p_partkey % 4 = 0 THEN 'missing' ELSE 'enriched' END AS status FROM part""")
def contract_stakes(spark, sf):
    p, k = read(spark, sf, "part"), F.col("p_partkey")
    address = F.when(k % 7 == 0, "0x" + "0" * 40).otherwise(F.concat(F.lit("0xc"), k.cast("string")))
    lists = p.where(k % 3 > 0).select(F.concat(F.lit("0xc"), k.cast("string")).alias("address"), F.when(k % 4 == 0, 0).otherwise(k).alias("stake"), F.lit(0).alias("place"))
    return ob.contract_stakes(p.select(k.alias("token"), address.alias("address"), (F.col("p_size") % 5 == 0).alias("complete")), lists)


@_query("""SELECT o_custkey AS wallet, count(*) AS total, bool_and(o_orderkey % 10 > 0) AS is_complete, coalesce(string_agg('stake-' || o_orderkey, ',' ORDER BY 'stake-' || o_orderkey) FILTER (WHERE o_orderkey % 10 = 0), '') AS warnings FROM orders GROUP BY ALL""")
def ended_rollup(spark, sf):
    k = F.col("o_orderkey")
    warn = F.when(k % 10 == 0, F.array(F.concat(F.lit("stake-"), k.cast("string")))).otherwise(F.array().cast("array<string>"))
    got = ob.ended_rollup(read(spark, sf, "orders").select(F.col("o_custkey").alias("wallet"), (k % 10 > 0).alias("complete"), warn.alias("warnings")))
    return got.withColumn("warnings", F.array_join("warnings", ","))


@_query("""SELECT o_custkey AS wallet, bool_and(o_totalprice > 0) AS positive, bool_and(o_orderkey % 20 > 0) AS whole, bool_and(o_orderstatus <> 'P') AS settled, CASE WHEN NOT bool_and(o_totalprice > 0) OR NOT bool_and(o_orderkey % 20 > 0) THEN 'FAIL' WHEN NOT bool_and(o_orderstatus <> 'P') THEN 'WARN' ELSE 'PASS' END AS verdict FROM orders GROUP BY ALL""")
def check_verdicts(spark, sf):
    rows = read(spark, sf, "orders").withColumnRenamed("o_custkey", "wallet")
    return ob.check_vector(rows, "wallet", {"positive": F.col("o_totalprice") > 0, "whole": F.col("o_orderkey") % 20 > 0, "settled": F.col("o_orderstatus") != "P"}, ["positive", "whole"])


@_query("""WITH a AS (SELECT c_custkey AS wallet, 'COMPLETED' AS status, c_custkey AS f, c_custkey + 9 AS t, 100 AS at FROM customer WHERE c_custkey % 3 > 0), b AS (SELECT c_custkey AS wallet, ['FAILED', 'COMPLETED', 'RUNNING'][c_custkey % 3 + 1] AS status, c_custkey + 10 AS f, c_custkey + 19 AS t, CASE WHEN c_custkey % 3 = 1 THEN 200 END AS at FROM customer WHERE c_custkey % 4 > 0)
SELECT coalesce(a.wallet, b.wallet) AS wallet, coalesce(b.status, a.status) AS status, CASE WHEN b.status = 'COMPLETED' THEN b.f ELSE a.f END AS from_block, CASE WHEN b.status = 'COMPLETED' THEN b.t ELSE a.t END AS to_block, coalesce(b.at, a.at) AS materialized_at FROM a FULL JOIN b ON a.wallet = b.wallet""")
def materialization_states(spark, sf):
    c, k = read(spark, sf, "customer"), F.col("c_custkey")
    kinds = F.array(F.lit("FAILED"), F.lit("COMPLETED"), F.lit("RUNNING"))
    old = c.where(k % 3 > 0).select(k.alias("wallet"), F.lit("COMPLETED").alias("status"), k.alias("from_block"), (k + 9).alias("to_block"), F.lit(100).alias("materialized_at"))
    new = c.where(k % 4 > 0).select(k.alias("wallet"), kinds[(k % 3).cast("int")].alias("status"), (k + 10).alias("from_block"), (k + 19).alias("to_block"), F.when(k % 3 == 1, 200).alias("materialized_at"))
    return ob.materialization_upsert(old, new)


@_query("""WITH r AS (SELECT c_custkey % 300 AS wallet, CASE c_custkey % 5 WHEN 0 THEN 'state' WHEN 1 THEN 'lp' WHEN 2 THEN 'stake' ELSE 'token' END AS kind, c_custkey AS b, c_acctbal AS balance FROM customer)
SELECT wallet, 369 AS chain_id, count(*) FILTER (WHERE kind = 'token') AS tokens, count(*) FILTER (WHERE kind = 'lp') AS lp, count(*) FILTER (WHERE kind = 'stake') AS stakes, count(*) FILTER (WHERE kind = 'token' AND balance < 0) AS negative, count(*) FILTER (WHERE kind = 'state') > 0 AS has_state,
CASE WHEN count(*) FILTER (WHERE kind = 'state') > 0 THEN min(b) FILTER (WHERE kind = 'state') ELSE min(b) FILTER (WHERE kind IN ('token', 'lp')) END AS from_block, CASE WHEN count(*) FILTER (WHERE kind = 'state') > 0 THEN max(b) FILTER (WHERE kind = 'state') ELSE max(b) FILTER (WHERE kind IN ('token', 'lp')) END AS to_block FROM r GROUP BY wallet""")
def materialization_diagnostics(spark, sf):
    k = F.col("c_custkey")
    r = read(spark, sf, "customer").select((k % 300).alias("wallet"), F.lit(369).alias("chain_id"), k.alias("from_block"), k.alias("to_block"), F.col("c_acctbal").alias("balance"), k.alias("k"))
    plain = r.drop("balance")
    return ob.diagnostics(plain.where("k % 5 = 0"), r.where("k % 5 > 2"), plain.where("k % 5 = 1"), plain.where("k % 5 = 2").drop("from_block", "to_block"))


@_query("""SELECT (SELECT count(*) FROM orders WHERE o_orderstatus <> 'F') AS blocks, (SELECT count(*) FROM customer WHERE c_custkey % 2 = 0) AS transactions, (SELECT count(*) FROM lineitem WHERE l_linestatus <> 'F') AS logs""")
def ingestion_counts(spark, sf):
    state = lambda c: F.when(c, "ACTIVE").otherwise("REORGED").alias("status")
    return ob.ingestion_counts(read(spark, sf, "orders").select(state(F.col("o_orderstatus") != "F")), read(spark, sf, "customer").select(state(F.col("c_custkey") % 2 == 0)), read(spark, sf, "lineitem").select(state(F.col("l_linestatus") != "F")))


_REQUESTS = "SELECT count(*) AS requests, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-30' AND (event_id % 6 = 0 OR event_type = 'error')) AS recent_errors FROM events"


def _requests(spark, sf):
    e = read(spark, sf, "events")
    rows = e.select(F.col("ts").cast("timestamp").alias("requested_at"), F.when(F.col("event_id") % 6 == 0, 500).otherwise(200).alias("status_code"), F.when(F.col("event_type") == "error", "bad").alias("error"))
    return ob.request_report(rows, F.lit("2024-01-31 00:00:00").cast("timestamp")).drop("latest")


@_query(_REQUESTS)
def request_report(spark, sf):
    return _requests(spark, sf)


@_query(f"""WITH q AS ({_REQUESTS}), i AS (SELECT count(*) FILTER (WHERE o_orderstatus <> 'F') AS n FROM orders) SELECT 'requests' AS report, '{{"requests":' || requests || ',"recent_errors":' || recent_errors || '}}' AS content FROM q UNION ALL SELECT 'ledger', '{{"active":' || n || '}}' FROM i""")
def composite_report(spark, sf):
    return ob.composite(requests=_requests(spark, sf), ledger=read(spark, sf, "orders").agg(F.count_if(F.col("o_orderstatus") != "F").alias("active")))


@_query("""SELECT o_custkey % 20 AS block, count(*) FILTER (WHERE o_orderkey % 3 > 0) AS fetched, count(*) FILTER (WHERE o_orderkey % 6 = 0) AS skipped, count(*) FILTER (WHERE o_orderkey % 6 = 3) AS failed FROM orders GROUP BY ALL""")
def price_ingestion(spark, sf):
    k = F.col("o_orderkey")
    reason = F.when(k % 6 == 0, "pdai_routing_reference").when(k % 6 == 3, "no-pool")
    return ob.ingested(read(spark, sf, "orders").select((F.col("o_custkey") % 20).alias("block"), F.when(k % 3 > 0, F.col("o_totalprice")).alias("price"), reason.alias("reason")))


@_query("""SELECT o_custkey AS wallet, count(*) AS assets, count(*) FILTER (WHERE o_orderkey % 4 > 0) AS valued, round(sum(CASE WHEN o_orderkey % 4 > 0 THEN (o_orderkey * 100 / 1000.0)::DOUBLE * 2 END), 4) AS total_value,
CASE WHEN count(*) FILTER (WHERE o_orderkey % 4 > 0) = count(*) THEN 'available' WHEN count(*) FILTER (WHERE o_orderkey % 4 > 0) = 0 THEN 'unavailable' ELSE 'partial' END AS status FROM orders GROUP BY ALL""")
def live_valuation(spark, sf):
    k = F.col("o_orderkey")
    got = ob.live_valuation(read(spark, sf, "orders").select(F.col("o_custkey").alias("wallet"), (k * 100).alias("raw"), F.lit(3).alias("decimals"), F.when(k % 4 > 0, 2.0).alias("price")))
    return got.withColumn("total_value", F.round(F.col("total_value").cast("double"), 4))


_ONBOARD = """w AS (SELECT c_custkey AS wallet FROM customer), r AS (SELECT c_custkey AS wallet, ['PENDING', 'RUNNING', 'FAILED', 'COMPLETED', 'COMPLETED', 'COMPLETED'][c_custkey % 6 + 1] AS status, c_custkey % 5 * 1000 AS age, CASE WHEN c_custkey % 25 = 0 THEN 1 ELSE 0 END AS warnings FROM customer WHERE c_custkey % 7 > 0),
m AS (SELECT c_custkey AS wallet, ['RUNNING', 'FAILED', 'COMPLETED', 'COMPLETED', 'COMPLETED', 'COMPLETED', 'COMPLETED', 'COMPLETED'][c_custkey % 8 + 1] AS status, c_custkey % 10 > 0 AS success, CASE WHEN c_custkey % 9 > 0 THEN 5 END AS f, 9 AS t, c_custkey % 4 * 1500 AS age, CASE WHEN c_custkey % 11 = 0 THEN 2 ELSE 0 END AS warnings FROM customer WHERE c_custkey % 13 > 1)"""


@_query(f"""WITH {_ONBOARD}, j AS (SELECT w.wallet, r.status AS rs, r.age AS ra, coalesce(r.warnings, 0) + coalesce(m.warnings, 0) AS warned, m.status AS ms, m.success, m.f, m.t, m.age AS ma FROM w LEFT JOIN r USING (wallet) LEFT JOIN m USING (wallet)),
x AS (SELECT *, CASE WHEN rs IS NULL AND ms IS NULL THEN 1 WHEN rs IN ('PENDING', 'RUNNING') THEN 2 WHEN rs = 'FAILED' THEN 3 WHEN ms IS NULL OR ms = 'RUNNING' THEN 4 WHEN ms = 'FAILED' THEN 5 WHEN NOT success THEN 6 WHEN f IS NULL THEN 7 WHEN rs = 'COMPLETED' AND ma > ra THEN 8 WHEN warned > 0 THEN 9 ELSE 10 END AS rule FROM j)
SELECT wallet, ['TRACKED_NOT_SYNCED', 'SYNC_IN_PROGRESS', 'SYNC_FAILED', 'CANONICAL_STATE_PARTIAL', 'CANONICAL_STATE_PARTIAL', 'CANONICAL_STATE_PARTIAL', 'CANONICAL_STATE_PARTIAL', 'CANONICAL_STATE_PARTIAL', 'CANONICAL_STATE_WARNING', 'CANONICAL_STATE_MATERIALIZED'][rule] AS status,
CASE WHEN rule = 2 THEN (rs = 'PENDING' AND ra > 900) OR (rs = 'RUNNING' AND ra > 3600) ELSE rule IN (1, 3, 5, 9) END AS action_required, rule IN (7, 8, 9, 10) AS holdings_visible FROM x""")
def wallet_onboarding(spark, sf):
    c, k = read(spark, sf, "customer"), F.col("c_custkey")
    pick = lambda names, n: F.element_at(F.array(*(F.lit(x) for x in names)), (k % n + 1).cast("int"))
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    ago = lambda s: F.timestamp_seconds(F.unix_seconds(now) - s)
    runs = c.where(k % 7 > 0).select(k.alias("wallet"), k.alias("run"), pick(["PENDING", "RUNNING", "FAILED", "COMPLETED", "COMPLETED", "COMPLETED"], 6).alias("status"), now.alias("created_at"), ago(k % 5 * 1000).alias("updated_at"), F.when(k % 25 == 0, 1).otherwise(0).alias("warnings"))
    done = ["RUNNING", "FAILED", *["COMPLETED"] * 6]
    states = c.where(k % 13 > 1).select(k.alias("wallet"), pick(done, 8).alias("status"), (k % 10 > 0).alias("success"), F.when(k % 9 > 0, 5).alias("from_block"), F.lit(9).alias("to_block"), ago(k % 4 * 1500).alias("materialized_at"), F.when(k % 11 == 0, 2).otherwise(0).alias("warnings"))
    return ob.onboarding(c.select(k.alias("wallet")), runs, states, now)


@_query("""WITH p AS (SELECT event_id, ['ONCHAIN_POOL', 'ONCHAIN_ROUTE', 'ORACLE', 'MANUAL', 'DEXSCREENER'][event_id % 5 + 1] AS source_type, CASE WHEN event_id % 5 = 0 AND event_id % 3 = 0 THEN 'pulsex:pulsex_v1:route:a' ELSE 'x' END AS source_id, (event_id % 100) / 100 AS confidence, ts FROM events WHERE event_type = 'view' AND ts >= TIMESTAMP '2024-01-24' AND event_id % 5 <> 2),
j AS (SELECT *, ts + INTERVAL 86400 SECOND < TIMESTAMP '2024-01-31' AS stale, source_id <> 'x' AS bad FROM p), g AS (SELECT source_type, count(*) AS n, count(*) FILTER (WHERE stale OR bad OR confidence < 0.5) AS rejected, arg_max(stale, {'t': ts, 'e': event_id}) AS ls, arg_max(bad, {'t': ts, 'e': event_id}) AS lb FROM j GROUP BY ALL),
s AS (SELECT unnest(['ONCHAIN_POOL', 'ONCHAIN_ROUTE', 'ORACLE', 'MANUAL', 'DEXSCREENER']) AS source_type)
SELECT source_type, CASE WHEN source_type = 'DEXSCREENER' THEN 'disabled' WHEN n IS NULL THEN 'unknown' WHEN lb OR ls THEN 'degraded' ELSE 'ok' END AS status, coalesce(n, 0) AS observations, CASE WHEN source_type = 'DEXSCREENER' THEN coalesce(n, 0) ELSE coalesce(rejected, 0) END AS rejected,
CASE WHEN source_type = 'DEXSCREENER' THEN 'source_disabled' WHEN n IS NULL THEN 'no_observations' WHEN lb THEN 'latest_observation_quote_ineligible' WHEN ls THEN 'latest_observation_stale' END AS reason FROM s LEFT JOIN g USING (source_type)""")
def source_status(spark, sf):
    from ..sources.tables import prices

    names = ["ONCHAIN_POOL", "ONCHAIN_ROUTE", "ORACLE", "MANUAL", "DEXSCREENER"]
    k = F.col("price_id")
    p = prices(spark, sf).where(k % 5 != 2).withColumns({"quote": F.lit("fiat:usd"), "source_id": F.when((k % 5 == 0) & (k % 3 == 0), "pulsex:pulsex_v1:route:a").otherwise("x")})
    sources = spark.createDataFrame([(n,) for n in names], "source_type string")
    return ob.source_status(sources, p, F.lit("2024-01-31 00:00:00").cast("timestamp"), ["DEXSCREENER"], "own")


_ASSET = "'chain:369:erc20:0x' || lpad({}::VARCHAR, 40, '0')"


@_query(f"""WITH b AS (SELECT l_orderkey % 60 AS wallet, l_partkey % 97 AS a, l_partkey, l_linenumber, CASE WHEN l_partkey % 97 = 5 THEN 0 ELSE l_quantity END AS balance, CASE WHEN l_partkey % 97 % 13 = 1 THEN NULL WHEN l_partkey % 97 % 13 = 2 THEN 25 ELSE 8 END AS decimals, lpad(l_orderkey::VARCHAR, 12, '0') || '/' || l_linenumber || '/' || lpad(l_partkey::VARCHAR, 12, '0') || '/' || lpad(l_suppkey::VARCHAR, 8, '0') || '/' || lpad(round(l_extendedprice * 100)::BIGINT::VARCHAR, 12, '0') AS row FROM lineitem),
r AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY wallet, a ORDER BY row) > 1 THEN 'DUPLICATE_ASSET' WHEN a % 10 = 9 THEN 'INVALID_CANONICAL_IDENTITY' WHEN a = 5 THEN 'ZERO_BALANCE' WHEN decimals IS NULL THEN 'MISSING_DECIMALS' WHEN decimals = 25 THEN 'INVALID_DECIMALS' WHEN a = 7 THEN 'PDAI_ROUTING_REFERENCE'
 WHEN a % 17 = 0 AND wallet % 2 = 0 THEN 'UNSUPPORTED_ASSET_CLASS' WHEN a % 11 = 0 THEN 'IGNORED_ASSET' WHEN a % 6 = 0 AND a % 4 > 0 THEN 'CONFLICTING_DECIMALS' END AS reason, wallet % 7 > 0 AS healthy FROM b),
p AS (SELECT *, CASE WHEN reason IS NULL AND healthy THEN row_number() OVER (PARTITION BY wallet, reason IS NULL ORDER BY a <> 40, {_ASSET.format("a")}) END AS place FROM r)
SELECT wallet, {_ASSET.format("a")} AS asset, row, healthy, reason, place, coalesce(place <= 5, FALSE) AS chosen FROM p""")
def price_candidates(spark, sf):
    name = lambda c: F.concat(F.lit("chain:369:erc20:0x"), F.lpad(c.cast("string"), 40, "0"))
    li, pad = read(spark, sf, "lineitem"), lambda c, n: F.lpad(c.cast("string"), n, "0")
    a, n = F.col("l_partkey") % 97, F.col("n")
    row = F.concat_ws("/", pad(F.col("l_orderkey"), 12), "l_linenumber", pad(F.col("l_partkey"), 12), pad(F.col("l_suppkey"), 8), pad(F.round(F.col("l_extendedprice") * 100).cast("long"), 12))
    b = li.select((F.col("l_orderkey") % 60).alias("wallet"), name(a).alias("asset"), F.when(a % 10 != 9, F.concat(F.lit("0X"), F.lpad(a.cast("string"), 40, "0"))).alias("address"), F.when(a % 13 == 1, F.lit(None).cast("int")).when(a % 13 == 2, 25).otherwise(8).alias("decimals"), F.when(a == 5, 0.0).otherwise(F.col("l_quantity")).alias("balance"), row.alias("row"))
    known = read(spark, sf, "part").select((F.col("p_partkey") % 97).alias("n")).distinct()
    tokens = known.where((n % 4 > 0) | (n % 11 == 0)).select(name(n).alias("asset"), (n % 11 == 0).alias("ignored"))
    sources = known.select(name(n).alias("asset"), F.when(n % 6 == 0, 9).otherwise(8).alias("decimals"))
    lp = known.where(n % 17 == 0).select(name(n).alias("asset"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(58).cast("long"), F.lit(2).cast("long"))).alias("wallet"))
    healthy = b.where(F.col("wallet") % 7 > 0).select("wallet", F.lit(True).alias("healthy")).distinct()
    return ob.candidates(b, tokens, sources, lp, healthy, 369, "chain:369:erc20:0x" + "7".rjust(40, "0"), "chain:369:erc20:0x" + "40".rjust(40, "0"), 5)

"""Vectors with hand-computed results, and streams against their batch form."""

import datetime as dt
import os
import subprocess
import sys
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import scalars, states
from ledgerloom.operators import accounting, evidence, observations, pricing, staking
from ledgerloom.streaming import windows

T, PLS, OTHER = "chain:369:erc20:0xt", "chain:369:native:0x0", "chain:369:erc20:0xu"
AT = dt.datetime(2026, 5, 8, 12)
SCHEMA = "wallet string, asset string, group_id string, tx string, id string, action_type string, entry_type string, direction string, quantity decimal(38,18), occurred_at timestamp"


def profit(spark, rows, mark=None, prices=None):
    entries = spark.createDataFrame([("w", a, g, tx, f"{k:03}", act, ty, d, Decimal(q), AT + dt.timedelta(hours=h)) for k, (a, g, tx, act, ty, d, q, h) in enumerate(rows)], SCHEMA)
    table = spark.createDataFrame([(a, Decimal(p)) for a, p in (prices if prices is not None else {PLS: 1}).items()], "asset string, price decimal(38,18)")
    marks = spark.createDataFrame([(T, Decimal(mark))] if mark is not None else [], "asset string, price decimal(38,18)")
    got = accounting.profit(entries, lambda legs: legs.join(table, "asset", "left"), marks).where(F.col("asset") == T).first()
    number = lambda x: x if x is None or isinstance(x, list) else Decimal(x)  # noqa: E731  numbers are text
    return {c: number(got[c]) for c in got.__fields__ if c not in ("wallet", "asset")}


def swap(asset, q, pay, n, h, sell=False):
    a, b = ("OUT", "IN") if sell else ("IN", "OUT")
    return [(asset, f"g{n}", f"x{n}", "SWAP", f"SWAP_{a}", a, q, h), (PLS, f"g{n}", f"x{n}", "SWAP", f"SWAP_{b}", b, pay, h)]


def test_buy_and_sell(spark):
    got = profit(spark, swap(T, 10, 100, 1, 0) + swap(T, 4, 60, 2, 1, sell=True), 15)
    assert [got[c] for c in ("holdings", "average_cost", "realized", "unrealized")] == [6, 10, 20, 30]
    assert (got["acquired"], got["disposed"], got["codes"]) == (10, 4, [])


def test_assets_stay_apart(spark):
    got = profit(spark, swap(T, 10, 100, 1, 0) + swap(OTHER, 50, 1, 2, 1), 15)
    assert [got[c] for c in ("holdings", "average_cost", "realized", "unrealized")] == [10, 10, 0, 50]


def test_siblings_are_refused(spark):
    rows = [(T, f"r{k}", f"t{k}", "TRANSFER", "RECEIVE", "IN", 1, 0) for k in range(20)]
    rows += [(T, "a", "x", "TRANSFER", "SEND", "OUT", 4, 1), (PLS, "b", "x", "TRANSFER", "RECEIVE", "IN", 60, 1)]
    got = profit(spark, rows, 1)
    assert (got["holdings"], got["disposed"], got["codes"]) == (20, 0, ["UNRESOLVED_ECONOMIC_COUPLING"])


def test_fees_and_zero_siblings_do_not_couple(spark):
    rows = [(T, "a", "x", "TRANSFER", "RECEIVE", "IN", 4, 1), (PLS, "b", "x", "TRANSFER", "FEE", "OUT", 1, 1), (OTHER, "c", "x", "TRANSFER", "SEND", "OUT", 0, 1)]
    got = profit(spark, rows, 1)
    assert (got["holdings"], got["average_cost"], got["codes"]) == (4, 0, [])


def test_fees_count_in_cost_and_proceeds(spark):
    rows = [*swap(T, 10, 100, 1, 0), (PLS, "g1", "x1", "SWAP", "FEE", "OUT", 5, 0), *swap(T, 4, 60, 2, 1, sell=True), (PLS, "g2", "x2", "SWAP", "FEE", "OUT", 2, 1)]
    got = profit(spark, rows, 15)
    assert (got["average_cost"], got["realized"]) == (Decimal("10.5"), 60 - 2 - 42)


@pytest.mark.parametrize(
    ("rows", "code"),
    [
        ([(T, "a", "x", "LP_ADD", "LP_ADD_OUT", "OUT", 1, 1)], "UNSUPPORTED_LP_ACTION"),
        ([(T, "a", "x", "HEX_STAKE_END", "STAKE_YIELD_RECEIVED", "IN", 1, 1)], "UNSUPPORTED_STAKE_ACTION"),
        ([(T, "a", "x", "TRANSFER", "FEE", "OUT", 1, 1)], "UNSUPPORTED_ACTION_GROUP"),
        ([(T, "a", "x", "SWAP", "SWAP_OUT", "OUT", 11, 1), (PLS, "a", "x", "SWAP", "SWAP_IN", "IN", 1, 1)], "INSUFFICIENT_COST_BASIS"),
        ([(T, "a", "x", "SWAP", "SWAP_IN", "IN", 1, 1), (OTHER, "a", "x", "SWAP", "SWAP_OUT", "OUT", 1, 1)], "COUNTER_ASSET_PRICE_UNAVAILABLE"),
    ],
)
def test_codes(spark, rows, code):
    got = profit(spark, swap(T, 10, 100, 1, 0) + rows, 10)
    assert (got["holdings"], got["average_cost"], got["codes"]) == (10, 10, [code])


def test_internal_transfers_are_silent_and_marks_may_lack(spark):
    got = profit(spark, [*swap(T, 10, 100, 1, 0), (T, "i", "y", "TRANSFER", "INTERNAL_TRANSFER", "INTERNAL", 3, 1)])
    assert (got["holdings"], got["unrealized"], got["codes"]) == (10, None, ["MARK_PRICE_UNAVAILABLE"])


def test_packed_words(spark):
    rows = [("0", "0", "0", "0", None), ("2361183241434822606849000", "1000", "500", "0", None), ("9444732965739290427391", "4722366482869645213695", "1", "0", None), ("4722366482869645213696", "0", "1", "0", None)]
    rows += [("156105216389714361993111211149973353148711912", "1000", "500", "7", None), ("-1", None, None, None, "negative"), (str(2**200), None, None, None, "exceeds-max")]
    got = spark.createDataFrame([(r[0],) for r in rows], "packed string").select("packed", scalars.decode_packed("packed").alias("d")).select("packed", "d.*").collect()
    assert [tuple(g) for g in got] == rows


def test_yield_vectors(spark):
    cases = {"A": (1000, [(10000, 100000)], "100"), "B": (1, [(10, 3)], "3"), "C": (500, [(2000, 10000)] * 3, "300"), "D": (100, [(5000, 1000), (8000, 2000), (0, 5000)], "900"), "E": (5000, [(12000, 5000)], "12000"), "Z": (5, [(7, 0)], "0")}
    for name, (shares, days, want) in cases.items():
        stakes = spark.createDataFrame([(name, shares, 10, len(days))], "stake string, shares long, locked_day int, staked_days int")
        table = spark.createDataFrame([(10 + k, p, t) for k, (p, t) in enumerate(days)], "day int, payout long, total_shares long")
        assert observations.exact_yield(stakes, table).first()["yield_units"] == want


def test_slices_of_days_give_the_same_yields_in_one_stage(spark):
    days = spark.createDataFrame([(d, 10**15 + d * 7, 0 if d % 11 == 0 else 10**9 + d) for d in range(100, 900) if d % 13], "day int, payout long, total_shares long").repartition(3)
    stakes = spark.createDataFrame([(k, 10**12 + k, (k * 37) % 1100, 1 + (k * 91) % 600) for k in range(300)], "stake int, shares long, locked_day int, staked_days int")
    want = {r["stake"]: r["yield_units"] for r in observations.exact_yield(stakes, days).collect()}
    got = observations.sliced_yield(stakes, days)
    assert {r["stake"]: r["yield_units"] for r in got.collect()} == want
    top = got._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert "Aggregate" not in top and "Generate" not in top
    assert {r["yield_units"] for r in observations.sliced_yield(stakes, days.where("false")).collect()} == {"0"}
    with pytest.raises(Exception, match="more than"):
        observations.sliced_yield(stakes, spark.createDataFrame([(1, 1, 1), (30_000, 1, 1)], days.schema)).collect()


def test_yield_of_large_numbers_is_exact(spark):
    big = 10**15
    row = spark.createDataFrame([(big, big, 7), (999999999, 9000000001, 7)], "s long, p long, t long").select(staking.wide_floor(F.col("s"), F.col("p"), F.col("t")).cast("string").alias("y"))
    assert [r["y"] for r in row.collect()] == [str(big * big // 7), str(999999999 * 9000000001 // 7)]


def test_best_price_prefers_later_observations_until_stale(spark):
    at = lambda m: dt.datetime(2026, 1, 1, 0, m)
    legs = spark.createDataFrame([(1, 7, at(10)), (2, 7, at(30)), (3, 8, at(1))], "leg long, asset long, at timestamp")
    prices = spark.createDataFrame([(1, 7, 5.0, "ORACLE", 0.9, at(5), 600), (2, 7, 6.0, "ONCHAIN_POOL", 0.6, at(20), 60), (3, 7, 9.0, "DEXSCREENER", 1.0, at(9), 6000), (4, 7, 8.0, "ONCHAIN_POOL", 0.4, at(9), 6000)], "price_id long, asset long, price double, source_type string, confidence double, observed_at timestamp, stale_after_seconds int")
    got = {r["leg"]: r["price_id"] for r in pricing.best_prices(legs, prices).collect()}
    assert got == {1: 2, 2: None, 3: None}
    strict = {r["leg"]: r["price_id"] for r in pricing.best_prices(legs, prices, strict=True).collect()}
    assert strict == {1: 1, 2: None, 3: None}


def test_payload_faults(spark):
    texts = ['{"schemaVersion":"v1","dailyData":["007"]}', None, "[1]", '{"a":{"b":1.5}}', "{}"]
    got = spark.createDataFrame([(t,) for t in texts], "p string").select(states.payload_code("p").alias("c")).collect()
    assert [r["c"] for r in got] == [None, "invalid-json", "numeric-json-value", "numeric-json-value", "missing-schema-version"]


def test_positions_replace_their_partitions_only(spark, tmp_path):
    path = str(tmp_path / "positions")
    rows = lambda *r: spark.createDataFrame(list(r), "chain_id int, wallet string, balance int")
    evidence.write_positions(rows((369, "a", 1), (369, "b", 2)), path)
    evidence.write_positions(rows((369, "a", 5)), path)
    assert sorted((r["wallet"], r["balance"]) for r in spark.read.parquet(path).collect()) == [("a", 5), ("b", 2)]


def test_lost_identities_fail(spark):
    rows = spark.createDataFrame([(1,), (2,)], "tx int")
    evidence.require_none(evidence.lost_identities(rows, rows, ["tx"]), "lost")
    with pytest.raises(ValueError, match="lost"):
        evidence.require_none(evidence.lost_identities(rows, rows.where("tx = 1"), ["tx"]), "lost")


def _stream(spark, sf="/root/testdata/sf0.001"):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return spark.read.parquet(f"{sf}/events.parquet"), spark.readStream.schema(schema).parquet(os.path.dirname(f"{sf}/events.parquet"), pathGlobFilter="events.parquet")


@pytest.mark.parametrize("name", ["tumbling", "sessions"])
def test_streams_equal_batches(spark, tmp_path, name):
    batch, stream = _stream(spark)
    plan = getattr(windows, name)
    q = plan(stream.withColumn("ts", F.col("ts").cast("timestamp"))).writeStream.outputMode("complete").format("memory").queryName(f"s_{name}").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(map(str, spark.table(f"s_{name}").collect()))
    assert got == sorted(map(str, plan(batch.withColumn("ts", F.col("ts").cast("timestamp"))).collect())) and got


def test_batches_append_exactly_once(spark, tmp_path):
    batch, stream = _stream(spark)
    path = str(tmp_path / "out")
    for k in range(2):  # the second run reads all again under a new checkpoint
        windows.append_batches(stream, path, ["event_id"], str(tmp_path / f"c{k}")).awaitTermination(120)
    assert spark.read.parquet(path).count() == batch.count()


def test_library_stands_without_the_corpus_operators():
    code = "import sys; sys.modules['ledgerloom.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert len(e.queries()) > 100 and 'pipeline' not in e.queries()"
    assert subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), check=False).returncode == 0

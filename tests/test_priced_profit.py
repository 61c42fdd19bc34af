"""Profit from stored prices, with numbers that outgrow doubles and Spark's decimals."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import accounting, pricing

T, PLS, OWN = "chain:369:erc20:0xt", "chain:369:native:0x0", "chain:369:erc20:0xown"
AT = dt.datetime(2026, 5, 8, 12)
ENTRY = "chain_id int, wallet string, asset string, group_id string, tx string, id string, action_type string, entry_type string, direction string, quantity string, occurred_at timestamp"
PRICE = "price_id long, chain_id int, asset string, quote string, price string, source_type string, source_id string, confidence double, liquidity double, observed_at timestamp, stale_after_seconds int"


def entries(spark, rows):
    return spark.createDataFrame([(369, "w", a, g, tx, f"{k:03}", act, ty, d, str(q), AT + dt.timedelta(hours=h)) for k, (a, g, tx, act, ty, d, q, h) in enumerate(rows)], ENTRY)


def buy(q, pay, n, h, sell=False):
    a, b = ("OUT", "IN") if sell else ("IN", "OUT")
    return [(T, f"g{n}", f"x{n}", "SWAP", f"SWAP_{a}", a, q, h), (PLS, f"g{n}", f"x{n}", "SWAP", f"SWAP_{b}", b, pay, h)]


def observed(spark, rows):
    base = {"chain_id": 369, "asset": PLS, "quote": "fiat:usd", "price": "1", "source_type": "ONCHAIN_POOL", "source_id": "x", "confidence": 0.95, "liquidity": 1e6, "h": 0, "stale_after_seconds": 3600}
    made = []
    for k, r in enumerate(rows):
        r = base | r
        made.append((k, r["chain_id"], r["asset"], r["quote"], r["price"], r["source_type"], r["source_id"], r["confidence"], r["liquidity"], AT + dt.timedelta(hours=r["h"]), r["stale_after_seconds"]))
    return spark.createDataFrame(made, PRICE)


def profit(spark, rows, prices, now=2):
    got = accounting.priced_profit(entries(spark, rows), observed(spark, prices), F.lit(AT + dt.timedelta(hours=now)), "fiat:usd", own_quote=OWN)
    return got.where(F.col("asset") == T).first()


def test_buy_and_sell_at_stored_prices(spark):
    prices = [{"h": h} for h in (0, 1)] + [{"asset": T, "price": "15", "h": 2}]
    got = profit(spark, buy(10, 100, 1, 0) + buy(4, 60, 2, 1, sell=True), prices)
    assert [got[c] for c in ("holdings", "average_cost", "realized", "unrealized")] == ["6", "10", "20", "30"]
    assert got["codes"] == []


@pytest.mark.parametrize("bad", [{"chain_id": 1}, {"quote": "fiat:eur"}, {"source_type": "DEXSCREENER"}, {"source_id": "pulsex:pdai:par"}, {"source_id": "pulsex:pulsex_v1:route:a"}, {"confidence": 0.49}, {"h": -2}])
def test_what_does_not_count_leaves_a_gap(spark, bad):
    got = profit(spark, buy(10, 100, 1, 0), [bad, {"asset": T, "price": "15", "h": 2}])
    assert (got["holdings"], got["codes"]) == ("0", ["COUNTER_ASSET_PRICE_UNAVAILABLE"])


def test_reasons_stand_in_order(spark):
    rows = [{"source_type": "DEXSCREENER", "source_id": "pulsex:pdai:par", "h": -9, "confidence": 0.1}, {"source_id": "pulsex:pdai:par", "h": -9, "confidence": 0.1}, {"h": -9, "confidence": 0.1}, {"confidence": 0.1}, {"confidence": 0.5}, {"source_id": "pulsex:pulsex_v2:route:z", "quote": OWN.upper()}]
    reason = pricing.reject_reason(F.lit(AT), 0.5, OWN)
    got = [r["r"] for r in observed(spark, rows).orderBy("price_id").select(reason.alias("r")).collect()]
    assert got == ["SOURCE_DISABLED", "UNVERIFIED_QUOTE_ASSUMPTION", "STALE", "LOW_CONFIDENCE", None, None]


@pytest.mark.parametrize(("q", "pay", "price"), [("1000000", "1000000", "0.0000000004"), ("2000000000", "1", "30000000000"), ("0.0000000001", "5", "7"), ("9" * 60, "1", "0.000000000000000001"), ("1", "8" * 50 + ".000000000000000001", "123456789.987654321")])
def test_small_and_large_numbers_are_exact(spark, q, pay, price):
    got = profit(spark, buy(q, pay, 1, 0), [{"price": price}])
    cost = accounting._EXACT.multiply(Decimal(pay), Decimal(price))
    assert got["holdings"] == accounting.plain(accounting._EXACT.plus(Decimal(q)))
    assert got["average_cost"] == accounting.plain(accounting._EXACT.divide(accounting._EXACT.plus(cost), accounting._EXACT.plus(Decimal(q))))
    assert got["codes"] == ["MARK_PRICE_UNAVAILABLE"]


def test_a_hot_asset_is_many_groups(spark):
    """All legs and observations of one asset against all pairs, in chunks of any width."""
    import random

    dice, hour = random.Random(4), dt.timedelta(hours=1)
    obs = [(k, 7, "usd", float(k), dice.choice(["ORACLE", "ONCHAIN_POOL", "MANUAL"]), dice.randrange(40, 100) / 100, AT + dice.randrange(400) * hour, dice.choice([0, 3600, 90_000])) for k in range(300)]
    legs = [(k, 7, "usd", AT + dice.randrange(-20, 450) * hour) for k in range(300)] + [(900, 8, "usd", AT), (901, 7, "eur", AT)]
    rank = {"ONCHAIN_POOL": 5, "ORACLE": 3, "MANUAL": 2}
    want = {}
    for leg, asset, quote, at in legs:
        fit = [(rank[o[4]], o[5], o[6], -o[0]) for o in obs if (asset, quote) == (7, "usd") and o[5] >= 0.5 and o[6] + dt.timedelta(seconds=o[7]) >= at]
        want[leg] = -max(fit)[3] if fit else None
    prices = spark.createDataFrame(obs, "price_id long, asset long, quote string, price double, source_type string, confidence double, observed_at timestamp, stale_after_seconds int")
    asked = spark.createDataFrame(legs, "leg long, asset long, quote string, at timestamp")
    for width in (3600, 86_400, 10**8):
        got = {r["leg"]: r["price_id"] for r in pricing.best_prices(asked, prices, by=("asset", "quote"), width_s=width).collect()}
        assert got == want


def test_any_cut_of_the_history_gives_the_same_states(spark):
    import random

    dice, rows = random.Random(6), []
    for k in range(400):
        kind = dice.choice(["acquire", "acquire", "dispose", None])
        code = "UNSUPPORTED_ACTION_GROUP" if kind is None else dice.choice([None, None, None, "COUNTER_ASSET_PRICE_UNAVAILABLE"])
        rows.append((dice.choice("ab"), dice.choice("xyz"), AT + dt.timedelta(minutes=dice.randrange(200)), f"{k:03}", kind, str(dice.randrange(1, 50)) if kind else None, f"{dice.randrange(900)}.25", "0.5", code))
    schema = "wallet string, asset string, first_at timestamp, first_id string, kind string, quantity string, value string, fees string, code string"
    frame = lambda part: spark.createDataFrame(part, schema)
    told = lambda df: sorted(map(str, df.collect()))
    whole = told(accounting.states(frame(rows)))
    by_time = sorted(rows, key=lambda r: (r[2], r[3]))
    for cuts, order in (([150], by_time), ([100, 250], by_time), ([200, 300], rows), ([399], by_time[::-1])):
        held, done, at = accounting.states(frame(order[: cuts[0]])), order[: cuts[0]], cuts[0]
        for cut in [*cuts[1:], len(order)]:
            held = spark.createDataFrame(accounting.resumed(held, frame(done), frame(order[at:cut])).collect(), held.schema)
            done, at = order[:cut], cut
        assert told(held) == whole
    assert [r["holdings"] for r in accounting.folded(frame(rows)).orderBy("wallet", "asset").collect()] == [r["holdings"] for r in held.orderBy("wallet", "asset").collect()]

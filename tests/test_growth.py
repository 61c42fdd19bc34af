"""Plans whose tasks and driver must not grow with the tables."""

import pytest

import __spark_entry__

QUERIES = __spark_entry__.queries()
SF = "/root/testdata/sf0.01"


def tree(df):
    """``depth, text`` of the operators of the plan before it runs."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    return [(len(x) - len(x.lstrip(" :+-")), x.strip(" :+-")) for x in lines]


def under(found, name):
    """For each operator of that name the texts of all below it."""
    for k, (depth, text) in enumerate(found):
        if text.startswith(name):
            below = []
            for d, t in found[k + 1 :]:
                if d <= depth:
                    break
                below.append(t)
            yield below


@pytest.mark.parametrize("name", ["stake_yield_exact", "verified_yields", "stake_yield"])
def test_days_go_to_stakes_and_no_exploded_stake_is_broadcast(spark, name):
    sent = list(under(tree(QUERIES[name](spark, SF)), "BroadcastExchange"))
    assert sent
    assert not any("explode" in t for below in sent for t in below)


def test_shapes_of_wallets_take_one_exchange_of_transfers(spark):
    found = [t for _, t in tree(QUERIES["wallet_swaps"](spark, SF)) if t.startswith("Exchange hashpartitioning(")]
    assert any("REPARTITION_BY" in t for t in found)
    assert not any("block_hash" in t for t in found if "ENSURE_REQUIREMENTS" in t)


def test_drafts_are_dealt_before_they_have_hashes_and_in_few_parts(spark, monkeypatch):
    from pyspark.sql import DataFrame

    from ledgerloom.plans import families

    kept, rows = [], []
    monkeypatch.setattr(families, "stored", lambda df, name, write=families.stored: kept.append((name, write(df, name))) or kept[-1][1])
    got = QUERIES["family_drafts"](spark, SF)
    assert isinstance(got, DataFrame)
    rows = {name: df.count() for name, df in kept}
    assert "raw" not in rows and rows["shapes"] < rows["ends"] / 10
    assert not any("group_id" in t for _, t in tree(got) if t.startswith("Exchange hashpartitioning("))


@pytest.mark.parametrize("name", ["swap_shape", "raw_swaps", "negative_balances", "lp_shape", "lp_warnings"])
def test_lines_travel_once_for_what_is_grouped_by_transaction(spark, name):
    found = [t for _, t in tree(QUERIES[name](spark, SF)) if t.startswith("Exchange hashpartitioning(")]
    assert any("REPARTITION_BY_NUM" in t and "l_orderkey" in t for t in found)
    assert not any("tx" in t or "direction" in t for t in found)


def test_tasks_grow_with_the_table(spark, monkeypatch):
    import os

    from ledgerloom.sources import tables

    size = os.path.getsize(f"{SF}/lineitem.parquet")
    monkeypatch.setattr(tables, "TASK_BYTES", size // 50)
    assert 50 <= tables.tasks(spark, SF, "lineitem") <= 52
    monkeypatch.setattr(tables, "TASK_BYTES", size * 2)
    assert tables.tasks(spark, SF, "lineitem") == int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.mark.parametrize("name", ["lp_positions", "sibling_coupling", "lp_shape", "lp_warnings"])
def test_parts_and_customers_are_not_broadcast_once_they_grow(spark, monkeypatch, name):
    from ledgerloom.sources import tables

    want = sorted(map(str, QUERIES[name](spark, SF).collect()))
    monkeypatch.setattr(tables, "SENT_BYTES", 1_000)
    got = QUERIES[name](spark, SF)
    assert not any("part.parquet" in t or "customer.parquet" in t for below in under(tree(got), "BroadcastExchange") for t in below)
    assert sorted(map(str, got.collect())) == want


def test_snapshots_are_dealt_to_a_number_of_tasks_that_is_not_merged_again(spark):
    found = [t for _, t in tree(QUERIES["native_snapshots"](spark, SF)) if "REPARTITION_BY_NUM" in t]
    assert sum(t.startswith("Exchange hashpartitioning(tx") for t in found) >= 2
    assert sum(t.startswith("Exchange hashpartitioning(transfer") for t in found) == 2
    assert any("l_orderkey" in t for t in found)


def test_entries_of_average_cost_travel_once_by_transaction_and_no_array_goes_to_python(spark):
    from ledgerloom.operators import accounting as operator
    from ledgerloom.plans import accounting

    own = tree(operator._group_assets(accounting.entries(spark, SF), ["wallet", "tx"], True))
    dealt = [t for _, t in own if t.startswith("Exchange hashpartitioning(")]
    assert any("REPARTITION_BY_NUM" in t and "l_orderkey" in t for t in dealt) and not any("tx" in t or "wallet" in t or "o_custkey" in t for t in dealt)
    assert not any(t.startswith("SortAggregate") for _, t in own)
    steps = accounting._steps(spark, SF)
    assert "decimal(34,0)" not in steps._jdf.queryExecution().optimizedPlan().toString()
    sent = operator.states(steps)._jdf.queryExecution().analyzed().children().head().schema().simpleString()
    assert "held:string" in sent


@pytest.mark.parametrize("name", ["family_ledger", "family_drafts", "provenance_repair", "wallet_swaps", "wallet_liquidity"])
def test_what_belongs_to_a_transaction_is_dealt_once_and_only_addresses_travel_to_many_wallets(spark, monkeypatch, name):
    from ledgerloom.operators import families

    want = sorted(map(str, QUERIES[name](spark, SF).collect()))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    monkeypatch.setattr(families, "SMALL", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = QUERIES[name](spark, SF)
        found = [t for _, t in tree(got) if t.startswith("Exchange hashpartitioning(")]
        assert sorted(map(str, got.collect())) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    dealt = [t.split("(")[1].split(")")[0] for t in found if "ENSURE_REQUIREMENTS" in t]
    assert not any("tx#" in t or "transfer#" in t or "group_id#" in t or ("address#" in t and "wallet#" not in t) for t in dealt)

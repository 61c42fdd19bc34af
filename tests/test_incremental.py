"""Merges, reorganisations, sinks and cursors: parts against the whole."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import scalars
from ledgerloom.operators import evidence, ledger, merge, positions, reorg, shapes, staking
from ledgerloom.sources.raw import read_raw, write_raw
from ledgerloom.streaming import cursors

AT = dt.datetime(2026, 5, 8)
ENTRY = "chain_id int, wallet string, tx string, id string, group_id string, action_type string, entry_type string, direction string, asset string, quantity string, occurred_at timestamp, transfer long"


def draft(wallet, tx, action, n=0, kind="SEND", transfer=None, fee=False):
    group = f"{tx}-{action}-{n}"
    return (369, wallet, tx, f"{wallet}-{tx}-fee" if fee else f"{wallet}-{group}-{kind}", group, action, "FEE" if fee else kind, "OUT", "pls" if fee else "t", "1", AT, transfer)


def families():
    """Drafts of four families; every action has a fee draft of its own, with one id for the transaction."""
    made = {"TRANSFER": [], "SWAP": [], "LP_ADD": [], "HEX_STAKE_LOCK": []}
    plan = {"x1": ["TRANSFER", "SWAP"], "x2": ["TRANSFER"], "x3": ["SWAP", "LP_ADD", "HEX_STAKE_LOCK"], "x4": ["TRANSFER", "HEX_STAKE_LOCK"], "x5": ["LP_ADD", "SWAP"]}
    for wallet, (tx, actions) in itertools.product("ab", plan.items()):
        for action in actions:
            made[action] += [draft(wallet, tx, action, fee=True)]
            if (tx, action) not in (("x1", "TRANSFER"), ("x4", "TRANSFER")):
                made[action] += [draft(wallet, tx, action)]
    return made


def owners(rows):
    return sorted((r.wallet, r.tx, r.group_id) for r in rows if r.entry_type == "FEE")


def test_any_order_and_split_of_families_gives_one_ledger(spark, tmp_path):
    made = families()
    frame = lambda rows: spark.createDataFrame(rows, ENTRY)
    whole = sorted(merge.merged(frame([]), frame([r for rows in made.values() for r in rows])).collect())
    assert owners(whole)[:5] == [("a", "x1", "x1-SWAP-0"), ("a", "x2", "x2-TRANSFER-0"), ("a", "x3", "x3-HEX_STAKE_LOCK-0"), ("a", "x4", "x4-HEX_STAKE_LOCK-0"), ("a", "x5", "x5-SWAP-0")]
    dice = random.Random(3)
    for k, order in enumerate(dice.sample(list(itertools.permutations(made)), 4)):
        path = str(tmp_path / f"ledger{k}")
        for family in order:
            rows = made[family] * (1 + k % 2)
            for part in (rows[::2], rows[1::2]) if k > 1 else (rows,):
                merge.apply(spark, path, frame(part))
        got = merge.read_entries(spark, path, frame([]))
        assert sorted(got.collect()) == whole
        # groups that only held a fee that moved away are gone
        assert not {"x1-TRANSFER-0", "x4-TRANSFER-0"} & {r.group_id for r in merge.groups_of(got).collect()}


def test_merge_rewrites_touched_partitions_only_and_removes_shadows(spark, tmp_path):
    path = str(tmp_path / "ledger")
    rows = [draft(w, f"x{k}", "TRANSFER", transfer=k) for w in "abc" for k in range(4)]
    rows += [(*draft("a", "x0", "TRANSFER", kind="RECEIVE")[:11], 77)]  # a second entry of x0's group, from a transfer that nothing consumes
    merge.apply(spark, path, spark.createDataFrame(rows, ENTRY))
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "ledger").rglob("*.parquet")}
    used = spark.createDataFrame([(0,), (1,)], "transfer long")
    merge.apply(spark, path, spark.createDataFrame([draft("a", "x1", "SWAP")], ENTRY), used)
    left = {(r.wallet, r.group_id) for r in merge.read_entries(spark, path, spark.createDataFrame([], ENTRY)).collect()}
    assert ("a", "x1-TRANSFER-0") not in left and ("a", "x0-TRANSFER-0") in left and ("a", "x1-SWAP-0") in left
    assert {("b", f"x{k}-TRANSFER-0") for k in range(4)} <= left
    after = {f: f.stat().st_mtime_ns for f in (tmp_path / "ledger").rglob("*.parquet")}
    assert all(after.get(f) == t for f, t in before.items() if "wallet=a" not in str(f))
    assert not any(f in after for f in before if "wallet=a" in str(f))


def normalise(raw):
    rows = raw.where("status = 'ACTIVE'")
    side = F.explode(F.array(F.struct(F.col("sender").alias("wallet"), F.lit("OUT").alias("direction"), F.lit("SEND").alias("entry_type")), F.struct(F.col("receiver").alias("wallet"), F.lit("IN").alias("direction"), F.lit("RECEIVE").alias("entry_type"))))
    rows = rows.select("chain_id", "tx", "log", "amount", side.alias("s")).select("*", "s.*")
    return rows.select("chain_id", "wallet", "tx", F.concat_ws("-", "wallet", "tx", "log").alias("id"), F.concat_ws("-", "tx", "log").alias("group_id"), F.lit("TRANSFER").alias("action_type"), "entry_type", "direction", F.lit("t").alias("asset"), F.col("amount").alias("quantity"), F.lit(AT).alias("occurred_at"), F.col("log").cast("long").alias("transfer"))


def place(entries):
    return positions.token_balances(entries, ["chain_id", "wallet", "asset"]).drop("warning")


def test_reorganised_range_equals_a_full_rebuild(spark, tmp_path):
    dice = random.Random(8)
    raw = [(dice.choice([1, 369]), f"x{k // 2}", k, k // 4, *dice.sample([f"w{i}" for i in range(12)], 2), str(dice.randrange(1, 9)), "ACTIVE") for k in range(160)]
    raw += [(369, "y", 900, 20, "only", "once", "5", "ACTIVE")]  # both wallets lose all
    df = spark.createDataFrame(raw, "chain_id int, tx string, log int, block_number int, sender string, receiver string, amount string, status string")
    at, held = str(tmp_path / "ledger"), str(tmp_path / "positions")
    merge.replace(normalise(df), at)
    evidence.write_positions(place(normalise(df)), held)
    before = {f for f in (tmp_path / "ledger").rglob("*.parquet")}
    touched = {tuple(r) for r in reorg.cascade(spark, df, at, held, 369, 18, 22, normalise, place).collect()}
    whole = normalise(reorg.marked(df, 369, 18, 22))
    got = merge.read_entries(spark, at, whole)
    assert sorted(got.collect()) == sorted(whole.select(*merge.ENTRY).collect())
    assert sorted(map(str, evidence.read_positions(spark, held).select("chain_id", "wallet", "asset", "balance").collect())) == sorted(map(str, place(whole).select("chain_id", "wallet", "asset", "balance").collect()))
    assert (369, "only") in touched and all(chain == 369 for chain, _ in touched)
    untouched = {f for f in before if not any(f"chain_id={c}/wallet={w}/" in str(f) for c, w in touched)}
    assert untouched and untouched <= {f for f in (tmp_path / "ledger").rglob("*.parquet")}


def test_few_reorganised_transactions_rewrite_a_part_of_a_wallet(spark, tmp_path):
    raw = [(369, f"x{k}", k, k, "a", f"w{k % 3}", "1", "ACTIVE") for k in range(200)]
    df = spark.createDataFrame(raw, "chain_id int, tx string, log int, block_number int, sender string, receiver string, amount string, status string")
    at, held = str(tmp_path / "ledger"), str(tmp_path / "positions")
    merge.replace(normalise(df), at)
    evidence.write_positions(place(normalise(df)), held)
    before = set((tmp_path / "ledger").rglob("*.parquet"))
    reorg.cascade(spark, df, at, held, 369, 7, 7, normalise, place)
    mine = {f for f in before if "wallet=a" in str(f)}
    left = mine & set((tmp_path / "ledger").rglob("*.parquet"))
    assert left and left != mine
    whole = normalise(reorg.marked(df, 369, 7, 7))
    assert sorted(merge.read_entries(spark, at, whole).collect()) == sorted(whole.select(*merge.ENTRY).collect())
    assert sorted(map(str, evidence.read_positions(spark, held).select("wallet", "balance").collect())) == sorted(map(str, place(whole).select("wallet", "balance").collect()))


def test_only_entries_of_repeated_ids_travel_by_id(spark, monkeypatch):
    from test_growth import tree, under

    old = spark.createDataFrame([draft("a", f"x{k}", "SWAP") for k in range(20)], ENTRY)
    rows = [draft(w, f"x{k}", action, kind=kind) for w in "ab" for k in range(10, 30) for action, kind in (("SWAP", "SEND"), ("SWAP", "RECEIVE"), ("TRANSFER", "SEND"))]
    rows += [(*r[:7], "IN", *r[8:]) for r in rows[::4]]  # the same ids, another content
    few = merge.merged(old, spark.createDataFrame(rows, ENTRY))
    by_id = [below for below in under(tree(few), "Exchange") if below[0].startswith("SortAggregate(key=[chain_id") and ", id#" in below[0].split("]")[0]]
    assert by_id and all(any("LeftSemi" in t for t in below) for below in by_id)
    monkeypatch.setattr(merge, "FEW", 0)
    many = merge.merged(old, spark.createDataFrame(rows, ENTRY))
    assert not any("LeftSemi" in t for _, t in tree(many))
    assert sorted(few.collect()) == sorted(many.collect())
    assert few.count() == 20 + 120 - 10


def test_folders_that_a_merge_leaves_without_entries_are_emptied(spark, tmp_path):
    path = str(tmp_path / "ledger")
    merge.apply(spark, path, spark.createDataFrame([draft("a", f"x{k}", "TRANSFER", transfer=k) for k in range(30)], ENTRY))
    merge.apply(spark, path, spark.createDataFrame([draft("a", "x0", "SWAP")], ENTRY), spark.range(30).select(F.col("id").alias("transfer")))
    assert [(r["tx"], r["action_type"]) for r in merge.read_entries(spark, path, spark.createDataFrame([], ENTRY)).collect()] == [("x0", "SWAP")]


def test_emptied_wallets_are_cleared_and_failures_leave_the_table(spark, tmp_path):
    path = str(tmp_path / "positions")
    rows = lambda *r: spark.createDataFrame(list(r), "chain_id int, wallet string, balance int")
    scope = lambda *w: spark.createDataFrame([(369, x) for x in w], "chain_id int, wallet string")
    left = lambda: sorted((r["wallet"], r["balance"]) for r in evidence.read_positions(spark, path).collect())
    evidence.write_positions(rows((369, "a", 1), (369, "a", 2), (369, "b", 3), (369, "c", 4)), path)
    evidence.write_positions(rows((369, "a", 9)), path, scope("a", "b"))
    assert left() == [("a", 9), ("c", 4)]
    evidence.write_positions(rows(), path, scope("a", "b", "never"))
    assert left() == [("c", 4)]
    bad = rows((369, "c", 7), (369, "d", 8)).repartition(2).withColumn("balance", F.when(F.col("balance") == 8, F.raise_error(F.lit("half way")).cast("int")).otherwise(F.col("balance")))
    with pytest.raises(Exception, match="half way"):
        evidence.write_positions(bad, path, scope("c", "d"))
    assert left() == [("c", 4)]
    evidence.write_positions(rows((369, "a", 5)), path, scope("a"))
    assert left() == [("a", 5), ("c", 4)]


def test_cursor_stream_equals_windows_folded_in_order(spark, tmp_path):
    dice = random.Random(5)
    source, rows = tmp_path / "windows", []
    schema = "wallet string, chain_id int, family string, seq long, from_block long, to_block long, block_hash string"
    for seq in range(240):
        low = dice.randrange(0, 400)
        rows.append((dice.choice("ab"), 369, dice.choice(["DEX", "LP"]), seq, low, low + dice.randrange(0, 90), None if dice.random() < 0.2 else f"h{seq}"))
    want, state = {}, {}
    for w, c, f, seq, low, high, h in rows:
        outcome, state[w, c, f] = cursors.merged_window(state.get((w, c, f)), low, high, h)
        want[seq] = (outcome, *state[w, c, f])
    assert {o for o, *_ in want.values()} == {"created", "merged", "unchanged", "refused", "disconnected"}
    for part in range(3):  # each run starts again from the checkpoint and finds new files; the last repeats old windows
        mine = rows[part * 80 : part * 80 + 80] + (rows[:20] if part == 2 else [])
        dice.shuffle(mine)
        spark.createDataFrame(mine, schema).repartition(3).write.mode("append").parquet(str(source))
        out = []
        stream = cursors.advanced(spark.readStream.schema(schema).parquet(str(source)))
        query = stream.writeStream.outputMode("update").foreachBatch(lambda b, _: out.extend(b.collect())).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        new = [r for r in out if r.outcome != "stale"]
        assert {r.seq: (r.outcome, r.from_block, r.to_block, r.block_hash) for r in new} == {s: want[s] for s in range(part * 80, part * 80 + 80)}
        assert len(out) - len(new) == (20 if part == 2 else 0)


def test_stake_locks_come_before_swaps_and_unknown_actions_have_no_family(spark):
    rows = spark.createDataFrame([(k, a) for k, a in enumerate(["TRANSFER", "SWAP", "HEX_STAKE_LOCK", "OTHER"])], "seq int, action_type string").withColumns({"chain_id": F.lit(1), "wallet": F.lit("w"), "tx": F.lit("x")})
    assert ledger.fee_owners(rows).first()["action_type"] == "HEX_STAKE_LOCK"
    got = [r["f"] for r in rows.orderBy("seq").select(scalars.source_family(F.col("action_type")).alias("f")).collect()]
    assert got == ["TRANSFERS", "DEX", "STAKING", None]


def test_payloads_that_are_no_json_are_rejected(spark):
    payloads = ['{"schemaVersion":"v1","dailyData":["1"]}', '{"dailyData":[1]}', "not json", '{"a":"b"', None]
    drafts = spark.createDataFrame([(k, 369, 1, 2, p) for k, p in enumerate(payloads)], "observation int, chain_id int, from_day int, to_day int, payload string")
    got = {r["observation"]: r["outcome"] for r in evidence.observations_to_store(drafts, drafts.withColumn("payload_hash", F.lit("")).limit(0)).collect()}
    assert got == {0: "created", 1: "rejected", 2: "rejected", 3: "rejected", 4: "rejected"}


def test_protocols_are_inferred_by_sender_and_receiver_of_the_call(spark):
    calls = spark.createDataFrame([("0xA", "W", "R"), ("0xb", "w", "r"), ("0xc", "w", "HEX"), ("0xd", "w", None), ("0xe", "w", "r")], "tx string, from_address string, to_address string")
    rows = [
        ("0xa", "t1", "t1", "w", "p"), ("0xa", "t2", "t2", "p", "r"),  # one out, another in
        ("0xb", "t1", "t1", "w", "p"), ("0xb", "t1", "t1", "p", "r"),  # the same asset both ways
        ("0xc", "hex", "hEx", "w", "x"), ("0xd", "t1", "t1", "w", "p"), ("0xd", "t2", "t2", "p", "w"),
        ("0xE", "t1", "t1", "W", "p"), ("0xe", "t2", "t2", "w", "p"), ("0xe", "t3", "t3", "p", "R"), ("0xf", "t1", "t1", "w", "r"),
    ]
    moves = spark.createDataFrame(rows, "tx string, asset string, token_address string, from_address string, to_address string")
    assert sorted(r["tx"] for r in shapes.inferred_protocols(moves, calls, "Hex").collect()) == ["0xa", "0xc", "0xe"]


def test_stakes_of_two_chains_stay_apart(spark):
    ends = spark.createDataFrame([(1, "w", 7, 90), (369, "w", 7, 95)], "chain_id int, wallet string, stake int, block int")
    starts = spark.createDataFrame([(1, "w", 7, 10, 1, 5, "3"), (369, "w", 7, 20, 1, None, "3")], "chain_id int, wallet string, stake int, block int, action_index int, locked_day int, shares string")
    got = {r["chain_id"]: (r["start_block"], r["complete"]) for r in staking.match_ends(ends, starts).collect()}
    assert got == {1: (10, True), 369: (20, False)}
    old = spark.createDataFrame([(1, "W", 7, 90, False), (369, "w", 7, 95, True)], "chain_id int, wallet string, stake int, end_block int, complete boolean")
    new = spark.createDataFrame([(1, "w", 7, 90, True), (369, "w", 7, 96, True), (5, "w", 7, 1, True)], old.schema)
    assert {r["chain_id"]: r["action"] for r in staking.upsert_ended(old, new).collect()} == {1: "updated", 369: "conflict", 5: "created"}


def test_ranges_of_blocks_read_their_buckets_alone(spark, tmp_path):
    path = str(tmp_path / "raw")
    rows = spark.range(4000).select((F.col("id") % 2 + 1).cast("int").alias("chain_id"), (F.col("id") * 7 % 5000).alias("block_number"), F.col("id").alias("log_index"))
    write_raw(rows.where("log_index < 2000"), path, 500)
    write_raw(rows.where("log_index >= 2000"), path, 500)
    assert sorted(read_raw(spark, path, size=500).select(*rows.columns).collect()) == sorted(rows.collect())
    got = read_raw(spark, path, 2, 1200, 1999, 500)
    want = rows.where("chain_id = 2 and block_number between 1200 and 1999")
    assert sorted(got.select(*rows.columns).collect()) == sorted(want.collect())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(chain_id" in plan and "block_bucket" in plan.split("PartitionFilters")[1].split("PushedFilters")[0] and "GreaterThanOrEqual(block_number,1200)" in plan
    from pathlib import Path

    folders = {str(Path(r["f"]).parent.name) for r in read_raw(spark, path, 2, 1200, 1999, 500).select(F.col("_metadata.file_path").alias("f")).distinct().collect()}
    assert folders == {"block_bucket=2", "block_bucket=3"}

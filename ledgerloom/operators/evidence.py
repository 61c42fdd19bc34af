"""Raw evidence: scans of one wallet's rows, sinks that add what is absent, and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.staging import dealt

#: Fixed value: the first topic of a token's transfer event.
TRANSFER_TOPIC = "0xddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef"
#: Families in the order in which they are synchronised.
MAX_WARNINGS = 200


def padded_topic(address: Column) -> Column:
    """An address as a 32-byte topic."""
    return F.concat(F.lit("0x" + "0" * 24), F.lower(F.substr(address, F.lit(3))))


def wallet_transfers(raw: DataFrame, wallet: str, low: int, high: int) -> DataFrame:
    """Active transfers from or to a wallet in a block range, by block and log index."""
    w = wallet.lower()
    return raw.where((F.col("status") == "ACTIVE") & F.col("block_number").between(low, high) & ((F.col("from_address") == w) | (F.col("to_address") == w))).orderBy("block_number", "log_index")


def wallet_rows(raw: DataFrame, wallet: str, low: int, high: int, by: str, order: list[str]) -> DataFrame:
    """Active rows whose column ``by`` is the wallet: transactions by sender, actions by initiator."""
    return raw.where((F.col("status") == "ACTIVE") & F.col("block_number").between(low, high) & (F.col(by) == wallet.lower())).orderBy(*order)


def wallet_logs(logs: DataFrame, wallet: str, low: int, high: int) -> DataFrame:
    """Active transfer logs that name a wallet as sender or receiver."""
    topic = padded_topic(F.lit(wallet))
    named = (F.col("topic1") == topic) | (F.col("topic2") == topic)
    return logs.where((F.col("status") == "ACTIVE") & F.col("block_number").between(low, high) & (F.col("topic0") == TRANSFER_TOPIC) & named)


def only_transfers(logs: DataFrame, wallet: str) -> DataFrame:
    """Each log with the reason against it: another event, or no topic of the wallet; null if it counts."""
    topic = padded_topic(F.lit(wallet))
    named = F.coalesce((F.col("topic1") == topic) | (F.col("topic2") == topic), F.lit(False))
    other = ~F.col("topic0").eqNullSafe(F.lit(TRANSFER_TOPIC))
    return logs.withColumn("reason", F.when(other, "not-a-transfer").when(~named, "wallet-not-named"))


def without_evidence(actions: DataFrame, after: Column, size: int) -> DataFrame:
    """The next ``size`` actions by id that have no evidence status yet."""
    return actions.where((F.col("id") > after) & F.col("evidence_status").isNull()).orderBy("id").limit(size)


def first_of(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key in an explicit order."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def insert_absent(old: DataFrame, new: DataFrame, key: list[str], order: list, lower: list[str] = ()) -> DataFrame:
    """The rows of ``new`` to append: hexadecimal columns in lower case, the first of each key, keys of ``old`` left out."""
    new = new.withColumns({c: F.lower(c) for c in lower})
    return first_of(new, key, order).join(old.select(*key), key, "left_anti")


def evidence_status(actions: DataFrame, edges: DataFrame) -> DataFrame:
    """Each action with RECORDED if it has an edge to a transfer, else VERIFIED_EMPTY."""
    n = edges.groupBy("action").agg(F.count("*").alias("edges"))
    return actions.join(n, "action", "left").select("action", F.coalesce("edges", F.lit(0)).alias("edges"), F.when(F.col("edges") > 0, "RECORDED").otherwise("VERIFIED_EMPTY").alias("evidence_status"))


def persisted_edges(plans: DataFrame, actions: DataFrame, key: list[str]) -> DataFrame:
    """Planned edges with the id of their stored action; plans without one are dropped."""
    return plans.join(actions.select(*key, "action"), key)


def upsert_metadata(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """All keys of both; what is new and known wins, what is not known keeps the old."""
    a, b = old.select(key, *columns).alias("a"), new.select(key, *columns).alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full")
    state = F.when(F.col(f"a.{key}").isNull(), "created").when(F.col(f"b.{key}").isNull(), "kept").otherwise("updated")
    return joined.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), *(F.coalesce(f"b.{c}", f"a.{c}").alias(c) for c in columns), state.alias("state"))


def price_drafts(drafts: DataFrame, old: DataFrame, seq: str) -> DataFrame:
    """Price drafts keyed by their content: of equal ids the last of the batch, without those stored."""
    from ..functions.scalars import content_id

    named = drafts.withColumn("id", content_id("po_", "chain_id", "asset", "source_type", "observed_at"))
    return first_of(named, ["id"], [F.desc(seq)]).join(old.select("id"), "id", "left_anti")


def holds_number(payload: Column) -> Column:
    """Whether a JSON text holds a number outside its strings."""
    return F.regexp_replace(payload, r'"(?:[^"\\]|\\.)*+"', '""').rlike("[0-9]")


def is_json(payload: Column) -> Column:
    """Whether a text is JSON, as its parser sees it; null is not."""
    return F.coalesce(F.try_parse_json(payload).isNotNull(), F.lit(False))


def observations_to_store(drafts: DataFrame, old: DataFrame) -> DataFrame:
    """Observations with the hash of their payload and what becomes of each: rejected, found or created.

    A payload that is no JSON is rejected, and one with a JSON number, as numbers lose digits; equal payloads of a range are one.
    """
    named = drafts.withColumn("payload_hash", F.sha2("payload", 256)).withColumn("bad", ~is_json(F.col("payload")) | holds_number(F.col("payload")))
    key = ["chain_id", "from_day", "to_day", "payload_hash"]
    known = old.select(*key).distinct().withColumn("known", F.lit(True))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("observation"))
    got = named.withColumn("rank", rank).join(known, key, "left")
    return got.select("observation", "payload_hash", F.when(F.col("bad"), "rejected").when(F.col("known") | (F.col("rank") > 1), "found").otherwise("created").alias("outcome"))


def encoded_days(days: DataFrame, key: list[str], version: str = "v1") -> DataFrame:
    """Packed days of each key as one canonical payload, in the order of the days; a range bounds the array."""
    packed = F.transform(F.array_sort(F.collect_list(F.struct("day", "packed"))), lambda x: x.packed.cast("string"))
    return days.groupBy(*key).agg(F.to_json(F.struct(F.lit(version).alias("schemaVersion"), packed.alias("dailyData"))).alias("payload"))


def scoped(entries: DataFrame, actions: list[str], txs: DataFrame | None = None, low: Column | None = None, high: Column | None = None) -> DataFrame:
    """What a rebuild deletes: entries of its actions, in its transactions, else in its time range, else all."""
    mine = entries.where(F.col("action_type").isin(actions))
    if txs is not None and not txs.isEmpty():
        return mine.join(txs.select("tx").distinct(), "tx", "left_semi")
    if low is not None and high is not None:
        return mine.where(F.col("occurred_at").between(low, high))
    return mine


def write_positions(rows: DataFrame, path: str, scope: DataFrame | None = None) -> None:
    """Replace all positions of the wallets and chains in ``scope``; of those that ``rows`` holds, if none is given.

    A wallet of the scope without rows is left with a tombstone, written in the same commit:
    its old rows go, and no list of wallets meets the driver.  Files are staged by the tasks
    and moved when all have ended, so a run that fails leaves the table as it was.
    """
    marked = rows.withColumn("gone", F.lit(False))
    if scope is not None:
        key = ["chain_id", "wallet"]
        empty = scope.select(*key).distinct().join(rows.select(*key), key, "left_anti").withColumn("gone", F.lit(True))
        marked = marked.unionByName(empty, allowMissingColumns=True)
    marked.hint("rebalance", "chain_id", "wallet").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chain_id", "wallet").parquet(path)


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """What :func:`write_positions` has left, without tombstones."""
    return spark.read.parquet(path).where("not gone").drop("gone")


def union_logs(incoming: DataFrame, outgoing: DataFrame) -> DataFrame:
    """Logs of both directions once each, by transaction, log index and block hash."""
    return incoming.unionByName(outgoing).dropDuplicates(["tx", "log_index", "block_hash"])


def lost_identities(scanned: DataFrame, persisted: DataFrame, key: list[str]) -> DataFrame:
    """Identities that were scanned and are not stored; there should be none."""
    return scanned.select(*key).exceptAll(persisted.select(*key))


def require_none(rows: DataFrame, what: str) -> None:
    """Fail if there is a row."""
    if not rows.isEmpty():
        raise ValueError(f"{what}: {rows.limit(5).collect()}")


def merge_warnings(*sources: DataFrame) -> DataFrame:
    """Distinct ``(wallet, code, message)`` of all sources."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s)
    return out.select("wallet", "code", "message").distinct()


def capped_warnings(warnings: Column, most: int = MAX_WARNINGS) -> Column:
    """The first ``most`` warnings and, if there are more, a marker with the number left out."""
    rest = F.size(warnings) - most
    return F.when(rest > 0, F.concat(F.slice(warnings, 1, most), F.array(F.concat(F.lit("warnings-truncated:"), rest.cast("string"))))).otherwise(warnings)


def emptied_groups(referenced: DataFrame, moved: DataFrame) -> DataFrame:
    """Groups whose entries have all moved elsewhere."""
    return moved.select("group_id").distinct().join(referenced.select("group_id").distinct(), "group_id", "left_anti")


def lp_evidence(actions: DataFrame, transfers: DataFrame) -> DataFrame:
    """One planned edge for each leg of a liquidity action that a transfer of its transaction covers.

    The roles are LP, ASSET0 and ASSET1; the pool's leg moves against the two others.
    """
    add = F.col("kind") == "LP_ADD"
    way = lambda lp: F.when(add == F.lit(lp), "IN").otherwise("OUT")
    legs = F.array(*(F.struct(F.lit(r).alias("role"), F.col(c).alias("asset"), way(r == "LP").alias("direction")) for r, c in (("LP", "lp_asset"), ("ASSET0", "asset0"), ("ASSET1", "asset1"))))
    planned = actions.select("tx", F.explode(legs).alias("leg")).select("tx", "leg.*")
    return planned.join(transfers.select("tx", "asset", "direction", "transfer"), ["tx", "asset", "direction"])


def native_snapshots(transactions: DataFrame, transfers: DataFrame, protocol: DataFrame, used: DataFrame, tasks: int | None = None) -> DataFrame:
    """What the transfer family normalises: token transfers, and native transactions of no protocol.

    ``shadow`` marks transfers that evidence has consumed; ``has_transfers`` marks native
    rows beside token transfers.  Within a block transactions come before transfers.
    Rows are dealt once by transaction and once by transfer, to ``tasks`` tasks, so a task's
    share need not grow with the tables.
    """
    transactions, protocol = dealt(transactions, tasks, "tx"), dealt(protocol.select("tx"), tasks, "tx")
    counts = dealt(transfers.select("tx"), tasks, "tx").groupBy("tx").agg(F.count("*").alias("transfers"))
    native = transactions.join(protocol.select("tx").distinct(), "tx", "left_anti").join(counts, "tx", "left")
    native = native.select("tx", "block_number", F.lit(0).alias("kind"), F.col("tx_index").alias("at"), F.lit(False).alias("shadow"), F.col("transfers").isNotNull().alias("has_transfers"))
    token = dealt(transfers, tasks, "transfer").join(dealt(used.select("transfer"), tasks, "transfer").distinct().withColumn("hit", F.lit(True)), "transfer", "left")
    token = token.select("tx", "block_number", F.lit(1).alias("kind"), F.col("log_index").alias("at"), F.col("hit").isNotNull().alias("shadow"), F.lit(True).alias("has_transfers"))
    return native.unionByName(token).orderBy("block_number", "kind", "at")


def not_transfer_logs(transfers: DataFrame, logs: DataFrame, key: list[str]) -> DataFrame:
    """Transfers whose log is of another event, or has no topic."""
    return transfers.join(logs, key).where(F.col("topic0").isNull() | (F.col("topic0") != TRANSFER_TOPIC))


def fabricated(transfers: DataFrame, logs: DataFrame, key: list[str]) -> DataFrame:
    """Repair of active transfers without proof: ``outcome`` by the active logs behind each.

    The single log of another event, or without topic, proves a transfer fabricated: it is
    to be marked REORGED.  No log or several leave it as it is.
    """
    other = ~F.col("topic0").eqNullSafe(F.lit(TRANSFER_TOPIC))
    n = logs.where("status = 'ACTIVE'").groupBy(*key).agg(F.count("*").alias("logs"), F.count_if(other).alias("others"))
    got = transfers.where("status = 'ACTIVE'").join(n, key, "left")
    outcome = F.when(F.col("logs").isNull(), "missing-log").when(F.col("logs") > 1, "ambiguous-logs").when(F.col("others") == 1, "fabricated").otherwise("backed")
    return got.withColumn("outcome", outcome)


def reorged(old: DataFrame, new: DataFrame, window: int) -> DataFrame:
    """Per chain the blocks whose hash changed, the first of them, and the window to read again."""
    got = old.alias("a").join(new.alias("b"), (F.col("a.chain_id") == F.col("b.chain_id")) & (F.col("a.block_number") == F.col("b.block_number")) & (F.col("a.block_hash") != F.col("b.block_hash")))
    got = got.groupBy(F.col("a.chain_id").alias("chain_id")).agg(F.count("*").alias("mismatched"), F.min("a.block_number").alias("from_block"), F.max("a.block_number").alias("last"))
    return got.select("chain_id", "mismatched", "from_block", F.least(F.col("last"), F.col("from_block") + window - 1).alias("to_block"))


def merged_cursor(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """A cursor's range and a window: joined where they touch, else the cursor as it is.

    A cursor moves forward only with the hash of its new last block; without, ``outcome``
    is ``refused``.  Columns are ``from_block, to_block, block_hash`` on both sides.
    """
    a, b = old.alias("a"), new.alias("b")
    got = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in key], "full")
    lo, hi, x, y = F.col("a.from_block"), F.col("a.to_block"), F.col("b.from_block"), F.col("b.to_block")
    outcome = (
        F.when(lo.isNull(), "created").when(x.isNull(), "unchanged").when((y > hi) & F.col("b.block_hash").isNull(), "refused").when((x > hi + 1) | (y + 1 < lo), "disconnected")
        .when((y > hi) | (x < lo), "merged").otherwise("unchanged")
    )
    got = got.select(*(F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in key), outcome.alias("outcome"), lo.alias("lo"), hi.alias("hi"), x.alias("x"), y.alias("y"), F.col("a.block_hash").alias("h"), F.col("b.block_hash").alias("g"))
    moved = F.col("outcome") == "merged"
    made = F.col("outcome") == "created"
    return got.select(
        *key, "outcome", F.when(made, F.col("x")).when(moved, F.least("lo", "x")).otherwise(F.col("lo")).alias("from_block"),
        F.when(made, F.col("y")).when(moved, F.greatest("hi", "y")).otherwise(F.col("hi")).alias("to_block"),
        F.when(made | (moved & (F.col("y") > F.col("hi"))), F.col("g")).otherwise(F.col("h")).alias("block_hash"),
    )


def cursor_gap(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """How a window stands to its cursor, and the blocks between them."""
    got = old.select(*key, F.col("from_block").alias("lo"), F.col("to_block").alias("hi")).join(new, key)
    way = (
        F.when(F.col("from_block") > F.col("hi") + 1, "disconnected-forward").when(F.col("to_block") + 1 < F.col("lo"), "disconnected-backward")
        .when((F.col("from_block") >= F.col("lo")) & (F.col("to_block") <= F.col("hi")), "contained").otherwise("connected")
    )
    gap = F.when(F.col("from_block") > F.col("hi") + 1, F.col("from_block") - F.col("hi") - 1).when(F.col("to_block") + 1 < F.col("lo"), F.col("lo") - F.col("to_block") - 1).otherwise(0)
    return got.select(*key, way.alias("way"), gap.alias("gap"))


def aligned_windows(spans: DataFrame, size: int, descending: bool = False) -> DataFrame:
    """Windows of ``size`` blocks on one grid that cover each ``[from_block, to_block]``, numbered in their order."""
    first = F.floor(F.col("from_block") / size).cast("long")
    last = F.floor(F.col("to_block") / size).cast("long")
    got = spans.select("*", F.explode(F.sequence(first, last)).alias("cell"))
    got = got.select(*spans.columns, F.greatest(F.col("cell") * size, "from_block").alias("low"), F.least(F.col("cell") * size + size - 1, "to_block").alias("high"))
    w = Window.partitionBy(*spans.columns).orderBy(F.desc("low") if descending else F.col("low"))
    return got.withColumn("number", F.row_number().over(w).cast("long"))


def rebuild_report(snapshots: DataFrame, groups: DataFrame) -> DataFrame:
    """Per family: snapshots, distinct groups, and the snapshots that made none."""
    n = snapshots.groupBy("family").agg(F.count("*").alias("snapshots"))
    g = groups.groupBy("family").agg(F.count_distinct("group_id").alias("groups"))
    return n.join(g, "family", "left").select("family", "snapshots", F.coalesce("groups", F.lit(0)).alias("groups"), F.greatest(F.col("snapshots") - F.coalesce("groups", F.lit(0)), F.lit(0)).alias("skipped"))


def identity_faults(rows: DataFrame, key: list[str], hexed: str) -> DataFrame:
    """What a unique key over lower-case identities would refuse: repeats, and mixed case."""
    low = F.lower(hexed)
    n = rows.select(*[k for k in key if k != hexed], low.alias("low"), (F.col(hexed) != low).alias("mixed"))
    by = [k for k in key if k != hexed] + ["low"]
    got = n.groupBy(*by).agg(F.count("*").alias("times"), F.count_if("mixed").alias("mixed"))
    return got.agg(F.count_if(F.col("times") > 1).alias("repeated"), F.coalesce(F.sum("mixed"), F.lit(0)).alias("mixed_case"))

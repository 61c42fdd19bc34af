"""Reports over positions, runs and transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import source_family


def portfolio_summary(positions: DataFrame) -> DataFrame:
    """Totals per wallet with a status; a position without a price is unvalued, never zero."""
    got = positions.groupBy("wallet").agg(
        F.count("*").alias("positions"), F.count("price").alias("valued"), F.sum(F.col("balance") * F.col("price")).alias("total_value")
    )
    status = F.when(F.col("valued") == F.col("positions"), "complete").when(F.col("valued") == 0, "unavailable").otherwise("partial")
    return got.select("wallet", "positions", "valued", (F.col("positions") - F.col("valued")).alias("unvalued"), "total_value", status.alias("status"))


def freshness(states: DataFrame, now: Column, limit_s: int = 900) -> DataFrame:
    age = (F.unix_micros(now) - F.unix_micros("updated_at")) / 1_000_000
    state = F.when(F.col("updated_at").isNull(), "unknown").when(age > limit_s, "stale").otherwise("fresh")
    return states.withColumn("freshness", state)


def metadata_status(sources: DataFrame, now: Column, limit_s: int = 30 * 86400) -> DataFrame:
    """Per asset: conflicting decimals, stale or observed; and the source observed last (ties by kind)."""
    w = Window.partitionBy("asset").orderBy(F.desc("observed_at"), "source_kind", "decimals")
    ranked = sources.withColumn("rank", F.row_number().over(w))
    got = ranked.groupBy("asset").agg(F.count_distinct("decimals").alias("kinds"), F.max("observed_at").alias("latest"), F.max(F.when(F.col("rank") == 1, F.col("source_kind"))).alias("source_kind"))
    age = (F.unix_micros(now) - F.unix_micros("latest")) / 1_000_000
    return got.select("asset", "source_kind", F.when(F.col("kinds") > 1, "conflicting").when(age > limit_s, "stale").otherwise("observed").alias("status"))


def page(groups: DataFrame, entries: DataFrame, size: int, after: tuple | None = None) -> DataFrame:
    """A page of transactions, newest first then by id, after a cursor ``(time, id)``, with their entries."""
    rows = groups if after is None else groups.where((F.col("occurred_at") < F.lit(after[0])) | ((F.col("occurred_at") == F.lit(after[0])) & (F.col("id") > F.lit(after[1]))))
    top = rows.orderBy(F.desc("occurred_at"), "id").limit(size)
    legs = entries.join(F.broadcast(top.select("id")), "id", "left_semi").groupBy("id").agg(F.count("*").alias("n_entries"), F.sum("quantity").alias("quantity"))
    return top.join(legs, "id", "left").select("id", "occurred_at", source_family(F.col("action_type")).alias("family"), F.coalesce("n_entries", F.lit(0)).alias("n_entries"), "quantity")


def run_status(runs: DataFrame, now: Column) -> DataFrame:
    """Seconds since the start, and whether a run is stale: pending 15 minutes or running 60."""
    age = ((F.unix_micros(now) - F.unix_micros("started_at")) / 1_000_000).cast("long")
    stale = ((F.col("state") == "PENDING") & (age > 900)) | ((F.col("state") == "RUNNING") & (age > 3600))
    return runs.select("*", age.alias("age_s"), stale.alias("stale"))


def latest_runs(runs: DataFrame) -> DataFrame:
    """Per wallet the newest run and the newest success."""
    at = F.struct("started_at", "run")
    return runs.groupBy("wallet").agg(F.max_by("state", at).alias("last_state"), F.max(F.when(F.col("state") == "SUCCESS", F.col("started_at"))).alias("last_success"), F.count("*").alias("runs"))


def onboarding(runs: DataFrame) -> DataFrame:
    """The first state that holds: failed, syncing, syncing-again, ready or waiting."""
    got = latest_runs(runs)
    ok = F.col("last_success").isNotNull()
    state = (
        F.when((F.col("last_state") == "FAILED") & ~ok, "failed").when((F.col("last_state") == "RUNNING") & ~ok, "syncing").when((F.col("last_state") == "RUNNING") & ok, "syncing-again").when(ok, "ready").otherwise("waiting")
    )
    return got.select("wallet", "runs", state.alias("onboarding"))


def blockers(runs: DataFrame, now: Column) -> DataFrame:
    got = run_status(runs.where(F.col("state").isin("PENDING", "RUNNING")), now)
    return got.groupBy("state").agg(F.count("*").alias("runs"), F.count_if("stale").alias("stale_runs"), F.min("age_s").alias("min_age_s"), F.max("age_s").alias("max_age_s"))


def conflicting(wanted: DataFrame, runs: DataFrame) -> DataFrame:
    """Whether an operation on a wallet and chain is blocked: by a rebuild anywhere, or a run of its own wallet and chain."""
    live = runs.where(F.col("state").isin("PENDING", "RUNNING"))
    own = live.select("wallet", "chain_id").distinct().withColumn("own", F.lit(True))
    rebuild = live.where("kind = 'REBUILD'").agg((F.count("*") > 0).alias("rebuild"))
    got = wanted.join(own, ["wallet", "chain_id"], "left").crossJoin(F.broadcast(rebuild))  # one row
    return got.select("wallet", "chain_id", (F.coalesce("own", F.lit(False)) | F.col("rebuild")).alias("blocked"))


def recent(runs: DataFrame, most: int = 25) -> DataFrame:
    """The newest runs."""
    return runs.orderBy(F.desc("started_at"), "run").limit(most)


def page_with_entries(groups: DataFrame, entries: DataFrame, size: int, after: tuple | None = None) -> DataFrame:
    """A page as :func:`page` has it, each transaction with its entries in order, and whether more follow.

    One row more than a page is read, so that the last row of a full page is the next cursor
    only if something stands behind it.  Entries are read for the page alone.
    """
    rows = groups if after is None else groups.where((F.col("occurred_at") < F.lit(after[0])) | ((F.col("occurred_at") == F.lit(after[0])) & (F.col("id") > F.lit(after[1]))))
    order = (F.desc("occurred_at"), F.col("id"))
    top = rows.orderBy(*order).limit(size + 1)
    top = top.withColumn("place", F.row_number().over(Window.orderBy(*order))).withColumn("more", F.count("*").over(Window.partitionBy()) > size)  # of a page
    own = entries.join(F.broadcast(top.select("id")), "id", "left_semi").groupBy("id").agg(F.array_sort(F.collect_list(F.struct(*[c for c in entries.columns if c != "id"]))).alias("entries"))
    return top.where(F.col("place") <= size).join(own, "id", "left").select("id", "occurred_at", "place", "entries", ((F.col("place") == size) & F.col("more")).alias("is_cursor"))

"""Staking: yields from daily data, their gates, coverage and matching of ends to starts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def wide_floor(shares: Column, payout: Column, total: Column) -> Column:
    """``floor(shares * payout / total)`` of integers whose product has up to 38 digits, exactly; null if ``total`` is 0.

    Less its rest the product divides evenly, so the quotient needs no places.
    """
    s, p, t = (c.cast("decimal(38,0)") for c in (shares, payout, total))
    t = F.nullif(t, F.lit(0).cast("decimal(38,0)"))
    product = (s * p).cast("decimal(38,0)")
    return ((product - product % t) / t).cast("decimal(38,0)")


def by_stake(stakes: DataFrame, days: DataFrame, *aggregates: Column) -> DataFrame:
    """Per ``stake, staked_days`` the aggregates over its days; of a day that ``days`` lacks ``known`` is null, as are the columns of ``days``.

    An interval join by exploding a stake's days, so it is an equi join on the day.  Days are few,
    whatever the number of stakes, so they go to every task, and no row of a stake is sent or
    met again but its sums: Spark takes a stake for as many rows before it is exploded as after.
    """
    each = stakes.select("stake", "staked_days", "shares", F.explode_outer(F.sequence("locked_day", F.col("locked_day") + F.col("staked_days") - 1)).alias("day"))
    return each.join(F.broadcast(days.withColumn("known", F.lit(True))), "day", "left").groupBy("stake", "staked_days").agg(*aggregates)


def stake_yield(stakes: DataFrame, days: DataFrame) -> DataFrame:
    """Sum over a stake's days of ``floor(shares * payout / total)``; days without shares add nothing."""
    part = F.when(F.col("total_shares") > 0, wide_floor(F.col("shares"), F.col("payout"), F.col("total_shares")))
    known = F.when(F.col("known"), F.coalesce(part, F.lit(0).cast("decimal(38,0)")))
    return by_stake(stakes, days, F.count("known").alias("days_seen"), F.sum(known).cast("long").alias("yield_units"))


def payload_days(payloads: DataFrame) -> DataFrame:
    """One row per day of a payload's range: ``day, payout, shares, sats``, from the packed words in order."""
    from ..functions.scalars import decode_packed

    words = F.from_json("payload", "schemaVersion string, dailyData array<string>")["dailyData"]
    each = payloads.select("from_day", F.posexplode(words).alias("place", "packed"))
    return each.select((F.col("from_day") + F.col("place")).alias("day"), decode_packed("packed").alias("d")).select("day", "d.payout", "d.shares", "d.sats")


def elapsed_end(now: Column) -> Column:
    return F.least(now - 1, F.col("locked_day") + F.col("staked_days") - 1)


def yield_gate(now: Column) -> Column:
    """First reason against a yield estimate, else ``estimated``; columns as in :func:`gated_yields`."""
    return (
        F.when(F.col("chain_id") != 369, "unsupported")
        .when(F.col("shares") <= 0, "invalid_observation")
        .when(F.col("observed_from").isNull(), "insufficient_observations")
        .when(F.col("invalidated"), "invalid_observation")
        .when(now <= F.col("locked_day"), "insufficient_observations")
        .when((F.col("observed_from") > F.col("locked_day")) | (F.col("observed_to") < elapsed_end(now)), "insufficient_observations")
        .otherwise("estimated")
    )


def gated_yields(stakes: DataFrame, observations: DataFrame, now: Column) -> DataFrame:
    """Each stake with its newest observation (by block, whether invalidated or not) and its gate."""
    w = Window.partitionBy("stake").orderBy(F.desc("observed_block"), "observation")
    newest = observations.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank", "observation")
    return stakes.join(newest, "stake", "left").select("stake", "observed_block", yield_gate(now).alias("status"))


def coverage(stakes: DataFrame, observations: DataFrame, now: Column) -> DataFrame:
    """Of each chain how many stakes are covered, lack evidence, or have no day behind them."""
    held = observations.where("not invalidated").groupBy("stake").agg(F.min("observed_from").alias("low"), F.max("observed_to").alias("high"))
    state = F.when(now <= F.col("locked_day"), "no-elapsed-days").when((F.col("low") <= F.col("locked_day")) & (F.col("high") >= now - 1), "covered").otherwise("missing")
    got = stakes.join(held, "stake", "left").withColumn("state", state)
    n = lambda s: F.count_if(F.col("state") == s)
    return got.groupBy("chain_id").agg(F.count("*").alias("stakes"), n("covered").alias("covered"), n("missing").alias("missing"), n("no-elapsed-days").alias("no_elapsed_days"))


def match_ends(ends: DataFrame, starts: DataFrame) -> DataFrame:
    """Each end with the latest start of its chain (``chain_id``, if the rows tell it), wallet and stake, and whether that start is whole."""
    key = [*(["chain_id"] if "chain_id" in ends.columns else []), "wallet", "stake"]
    w = Window.partitionBy(*key).orderBy(F.desc("block"), F.desc("action_index"))
    latest = starts.withColumn("rank", F.row_number().over(w)).where("rank = 1").select(*key, F.col("block").alias("start_block"), F.col("locked_day").alias("since"), F.col("shares").alias("held"))
    whole = F.col("since").isNotNull() & F.coalesce(F.col("held").rlike("^[0-9]+$"), F.lit(False))
    return ends.join(latest, key, "left").select(*key, F.col("block").alias("end_block"), "start_block", whole.alias("complete"))


def upsert_ended(old: DataFrame, new: DataFrame) -> DataFrame:
    """What an upsert does per stake: created, kept, updated (incomplete to complete), conflict or none.

    A stake is known by chain, wallet (of any case) and number, as far as both sides tell them.
    """
    key = [c for c in ("chain_id", "wallet", "stake") if c in old.columns and c in new.columns]
    named = lambda df: df.withColumn("wallet", F.lower("wallet")) if "wallet" in key else df
    a, b = named(old).alias("a"), named(new).alias("b")
    joined = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in key], "full")
    action = (
        F.when(F.col("a.stake").isNull(), "created")
        .when(F.col("b.stake").isNull(), "kept")
        .when(F.col("a.end_block") != F.col("b.end_block"), "conflict")
        .when(~F.col("a.complete") & F.col("b.complete"), "updated")
        .otherwise("no-op")
    )
    return joined.select(*(F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in key), action.alias("action"))

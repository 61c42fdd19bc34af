"""Prices: eligibility, ranking and coverage of observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import SOURCE_PRIORITY
from ..functions.states import quote_unverified


def source_rank(source: Column) -> Column:
    out = F.when(F.lit(False), 0)
    for name, rank in SOURCE_PRIORITY.items():
        out = out.when(source == name, rank)
    return out.otherwise(0)


def _expiry() -> Column:
    return F.unix_micros("observed_at") + F.col("stale_after_seconds").cast("long") * 1_000_000


def reject_reason(at: Column | None, least: float, own_quote: str | None = None) -> Column:
    """First reason against an observation at a time (at any time, if none is given); later observations are eligible.

    With ``own_quote``, the quote asset of the routes, observations that assume its parity
    are refused by ``source_id`` and ``quote``.
    """
    rules = [(~F.col("source_type").isin(*SOURCE_PRIORITY), "SOURCE_DISABLED")]
    if own_quote is not None:
        rules.append((F.coalesce(quote_unverified(F.col("source_id"), F.col("quote"), own_quote.lower()), F.lit(False)), "UNVERIFIED_QUOTE_ASSUMPTION"))
    if at is not None:
        rules.append((_expiry() < F.unix_micros(at), "STALE"))
    rules.append((F.col("confidence") < least, "LOW_CONFIDENCE"))
    out = F.when(*rules[0])
    for rule in rules[1:]:
        out = out.when(*rule)
    return out


def series(prices: DataFrame, chain: int, asset, quote: str) -> DataFrame:
    """Observations of an asset in one quote, the newest first, then the last stored."""
    return prices.where((F.col("chain_id") == chain) & (F.col("asset") == asset) & (F.col("quote") == quote)).orderBy(F.desc("observed_at"), F.desc("created_at"))


def _rank(prices: DataFrame) -> Column:
    """The order among eligible observations: source, confidence, time, liquidity (unknown as zero), then id."""
    liquidity = F.coalesce(F.col("liquidity"), F.lit(0.0)) if "liquidity" in prices.columns else F.lit(0.0)
    return F.struct(source_rank(F.col("source_type")).alias("s"), "confidence", "observed_at", liquidity.alias("l"), (-F.col("price_id")).alias("i"), "price_id", "price")


def best_prices(
    legs: DataFrame, prices: DataFrame, least: float = 0.5, strict: bool = False, width_s: int = 86_400, by: tuple[str, ...] = ("asset",), own_quote: str | None = None
) -> DataFrame:
    """The best eligible observation for every leg ``leg, *by, at``; null where there is none.

    ``by`` is what leg and observation share, such as chain, asset and quote.  An observation
    after ``at`` counts unless ``strict``; only the time at which it goes stale bounds it.  So
    the best for a leg is a maximum over all that expire later.  It is found on two levels: time
    is cut into chunks of ``width_s`` seconds, and each (asset, chunk) is sorted alone for its
    running maximum, so a hot asset is as many tasks' as it has chunks; the best of each chunk,
    which Spark combines before the shuffle, is carried to the chunks before it.  No leg meets
    every observation.  With both bounds, observations meet legs in the chunks that their
    validity touches.
    """
    by, cell = list(by), lambda c: F.floor(c / (width_s * 1_000_000)).cast("long")
    ok = prices.where(reject_reason(None, least, own_quote).isNull())
    ok = ok.select(*by, _rank(ok).alias("rank"), F.unix_micros("observed_at").alias("since"), _expiry().alias("until"))
    asked = legs.select("leg", *by, F.unix_micros("at").alias("t"))
    if strict:
        spread = ok.select("*", F.explode(F.sequence(cell(F.col("since")), cell(F.col("until")))).alias("cell"))
        got = asked.withColumn("cell", cell(F.col("t"))).join(spread, [*by, "cell"]).where("since <= t and t <= until").groupBy("leg").agg(F.max("rank").alias("best"))
        return legs.join(got, "leg", "left").select("leg", *by, F.col("best.price_id").alias("price_id"), F.col("best.price").alias("price"))
    kind = ok.schema["rank"].dataType
    rows = asked.select("leg", *by, F.col("t").alias("key"), F.lit(1).alias("asks"), F.lit(None).cast(kind).alias("rank"))
    rows = rows.unionByName(ok.select(F.lit(None).cast(legs.schema["leg"].dataType).alias("leg"), *by, F.col("until").alias("key"), F.lit(0).alias("asks"), "rank")).withColumn("cell", cell(F.col("key")))
    later = Window.partitionBy(*by).orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy(*by, "cell").agg(F.max("rank").alias("best")).select(*by, "cell", F.max("best").over(later).alias("carried"))
    inside = Window.partitionBy(*by, "cell").orderBy(F.desc("key"), "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    got = rows.withColumn("best", F.max("rank").over(inside)).where("asks = 1").join(carried, [*by, "cell"], "left")
    best = F.greatest("best", "carried")
    return got.select("leg", *by, best.price_id.alias("price_id"), best.price.alias("price"))


def resolver(prices: DataFrame, quote: str, least: float = 0.5, own_quote: str | None = None, by: tuple[str, ...] = ("asset",), width_s: int = 86_400):
    """A function that adds ``price``, as text, to distinct rows of ``*by, at``, from the stored observations in one quote."""
    stored = prices.where(F.col("quote") == quote)

    def prices_at(asked: DataFrame) -> DataFrame:
        legs = asked.select(F.struct(*by, "at").alias("leg"), *by, "at")
        got = best_prices(legs, stored, least, by=by, width_s=width_s, own_quote=own_quote)
        text = F.col("price").cast("decimal(38,18)").cast("string") if stored.schema["price"].dataType.typeName() in ("double", "float") else F.col("price").cast("string")
        return got.select(*by, F.col("leg.at").alias("at"), text.alias("price"))

    return prices_at


def pricing_status(sources: DataFrame, prices: DataFrame, now: Column, least: float = 0.5) -> DataFrame:
    """One row per known source: counts, latest time and status; a source without prices has zeros."""
    judged = prices.withColumn("reason", reject_reason(now, least))
    got = judged.groupBy("source_type").agg(F.count("*").alias("n"), F.count("reason").alias("rejected"), F.max("observed_at").alias("latest"), F.max_by("reason", "observed_at").alias("last_reason"))
    state = F.when(F.col("n").isNull(), "unavailable").when(F.col("last_reason").isin("SOURCE_DISABLED", "LOW_CONFIDENCE"), "ineligible").when(F.col("last_reason") == "STALE", "stale").otherwise("available")
    return sources.join(got, "source_type", "left").select("source_type", F.coalesce("n", F.lit(0)).alias("observations"), F.coalesce("rejected", F.lit(0)).alias("rejected"), "latest", state.alias("status"))


def ingest_candidates(balances: DataFrame, tokens: DataFrame, most: int) -> DataFrame:
    """The first ``most`` assets worth a price, native first; others with the first reason against them."""
    got = balances.join(tokens, "asset", "left")
    reason = F.when(F.col("decimals").isNull(), "UNKNOWN_TOKEN").when(F.col("balance") <= 0, "NO_BALANCE").when(F.col("is_lp"), "LP_TOKEN")
    got = got.withColumn("reason", reason)
    rank = F.row_number().over(Window.partitionBy("wallet", F.col("reason").isNull()).orderBy(F.desc("is_native"), "asset"))
    return got.withColumn("rank", F.when(F.col("reason").isNull(), rank)).select("wallet", "asset", "reason", "rank", (F.col("rank") <= most).alias("chosen"))

"""Observations of stakes, prices and runs: estimates, upserts, recoveries and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import wide
from ..functions.states import CHAIN, EXTRA_PAY_DAY, evidence_reason
from .staking import by_stake, elapsed_end, wide_floor


def _exact_units() -> Column:
    part = F.when(F.col("total_shares") > 0, wide_floor(F.col("shares"), F.col("payout"), F.col("total_shares")))
    return F.coalesce(F.sum(part).cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)")).cast("string")


def exact_yield(stakes: DataFrame, days: DataFrame) -> DataFrame:
    """Integer yield of each stake over its days: multiply first, floor each day, skip days without shares."""
    return by_stake(stakes, days, _exact_units().alias("yield_units")).select("stake", "yield_units")


#: Most days that one table of daily data may have: sixty years.
MOST_DAYS = 22_000


def sliced_yield(stakes: DataFrame, days: DataFrame) -> DataFrame:
    """What :func:`exact_yield` gives, without a row for each stake and day.

    Days are few, whatever the number of stakes: they become one array without gaps, its size
    checked, which travels to every task once.  Each stake folds its own slice of it, so stakes
    are neither exploded nor shuffled.  Days are distinct; those before the first or after the
    last one known add nothing.
    """
    span = days.agg(F.min("day").alias("first"), F.max("day").alias("last"))
    grid = span.where("first is not null").select(F.explode(F.sequence("first", "last")).alias("day"))
    cell = F.struct("day", F.col("payout").cast("decimal(38,0)").alias("payout"), F.col("total_shares").cast("decimal(38,0)").alias("total"))
    table = grid.join(days, "day", "left").agg(F.count("*").alias("n"), F.min("day").alias("first"), F.array_sort(F.collect_list(cell)).alias("days"))
    checked = F.when(F.col("n") <= MOST_DAYS, F.col("days")).otherwise(F.raise_error(F.lit(f"more than {MOST_DAYS} days")).cast(table.schema["days"].dataType))
    table = table.select("first", checked.alias("days"))
    nothing = F.lit(0).cast("decimal(38,0)")
    low = F.greatest(F.col("locked_day") - F.col("first"), F.lit(0))
    size = F.greatest(F.least(F.col("locked_day") + F.col("staked_days") - F.col("first"), F.size("days")) - low, F.lit(0))

    def add(total: Column, day: Column) -> Column:
        part = F.when(day.total > 0, wide_floor(F.col("shares"), day.payout, day.total))
        return (total + F.coalesce(part, nothing)).cast("decimal(38,0)")

    units = F.when(F.col("first").isNull(), nothing).otherwise(F.aggregate(F.slice("days", low + 1, size), nothing, add))
    return stakes.join(F.broadcast(table)).select("stake", units.cast("string").alias("yield_units"))  # one row joins all


def exact_range(observations: DataFrame) -> DataFrame:
    """The newest observation of each exact range by block, invalidated or not."""
    w = Window.partitionBy("chain_id", "from_day", "to_day").orderBy(F.desc("observed_block"), "observation")
    return observations.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def estimates(stakes: DataFrame, observations: DataFrame, now: Column) -> DataFrame:
    """Each stake with the first gate that closes, else ``estimated``, and its warning.

    Evidence is the newest observation of exactly the elapsed days; an invalidated newest
    one hides older ones.  Columns of ``stakes``: ``stake, chain_id, shares, locked_day,
    staked_days``; of ``observations``: ``observation, chain_id, from_day, to_day,
    observed_block, failed, invalidated, valid``.
    """
    asked = stakes.withColumns({"low": F.col("locked_day"), "high": elapsed_end(now)})
    held = exact_range(observations).select(F.col("chain_id").alias("c"), F.col("from_day").alias("low"), F.col("to_day").alias("high"), "observation", "failed", "invalidated", "valid")
    got = asked.join(held, (F.col("chain_id") == F.col("c")) & (asked.low == held.low) & (asked.high == held.high), "left")
    status = (
        F.when(F.col("chain_id") != CHAIN, "unsupported").when(F.col("shares") <= 0, "invalid_observation").when(F.col("failed"), "unavailable").when(F.col("observation").isNull(), "insufficient_observations")
        .when(F.col("invalidated"), "invalid_observation").when(~F.col("valid"), "invalid_observation").when(now <= F.col("locked_day"), "insufficient_observations").otherwise("estimated")
    )
    unresolved = (F.col("locked_day") <= EXTRA_PAY_DAY) & (elapsed_end(now) >= EXTRA_PAY_DAY)
    got = got.withColumn("status", status)
    warning = F.when((F.col("status") == "estimated") & unresolved, "bpd-attribution-unresolved")
    pay = F.when(F.col("status") != "estimated", "unknown").when(unresolved, "unknown").when((F.col("locked_day") <= EXTRA_PAY_DAY) & (F.col("locked_day") + F.col("staked_days") > EXTRA_PAY_DAY), "applicable").otherwise("not_applicable")
    return got.select("stake", "observation", "status", warning.alias("warning"), pay.alias("extra_pay"))


def verified_yield(stakes: DataFrame, days: DataFrame, claimed: DataFrame) -> DataFrame:
    """The yield computed again from the days, against what was claimed; a range with days missing is not verified."""
    again = by_stake(stakes, days, _exact_units().alias("again"), F.count("known").alias("entries"))
    got = again.join(claimed.hint("merge"), "stake")
    result = F.when(~F.coalesce(F.col("entries") == F.col("staked_days"), F.lit(False)), "entry-count-mismatch").when(F.col("again") == F.col("yield_units"), "match").otherwise("mismatch")
    return got.select("stake", result.alias("result"))


def coverage_report(stakes: DataFrame, observations: DataFrame, now: Column) -> DataFrame:
    """Reason against the evidence of each stake with an elapsed day; the range ends yesterday."""
    asked = stakes.where(now - 1 >= F.col("locked_day")).select("stake", F.col("locked_day").alias("low"), (now - 1).alias("high"))
    held = exact_range(observations).select("from_day", "to_day", "invalidated", "valid")
    got = asked.join(held, (F.col("low") == F.col("from_day")) & (F.col("high") == F.col("to_day")), "left")
    return got.select("stake", evidence_reason(F.col("from_day"), F.col("to_day"), F.col("low"), F.col("high"), F.col("invalidated"), F.col("valid")).alias("reason"))


def latest_valid(observations: DataFrame, invalidations: DataFrame) -> DataFrame:
    """Per chain the newest observation without an invalidation."""
    ok = observations.join(invalidations.select("observation").distinct(), "observation", "left_anti")
    return ok.groupBy("chain_id").agg(F.max_by("observation", F.struct("observed_block", "observation")).alias("observation"), F.max("observed_block").alias("observed_block"))


def upsert_action(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """What storing an ended stake does: conflict if its end lies in another block or transaction."""
    a, b = old.alias("a"), new.alias("b")
    got = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in key], "right")
    other = (F.col("a.end_block") != F.col("b.end_block")) | (F.lower("a.end_tx") != F.lower("b.end_tx"))
    action = F.when(F.col("a.end_block").isNull(), "created").when(other, "conflict").when(~F.col("a.complete") & F.col("b.complete"), "updated").otherwise("no-op")
    return got.select(*(F.col(f"b.{k}").alias(k) for k in key), action.alias("action"))


def enrich(rows: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """Compare and set: a row that still has no start takes the one found; else what stands against it."""
    a, b = rows.alias("a"), found.alias("b")
    got = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in key], "right")
    same = (F.col("a.locked_day") == F.col("b.locked_day")) & (F.col("a.shares") == F.col("b.shares"))
    outcome = (
        F.when(F.col(f"a.{key[0]}").isNull(), "not-found").when(F.col("a.end_block") != F.col("b.end_block"), "evidence-changed")
        .when(F.col("a.complete") & same, "already-complete").when(F.col("a.complete"), "conflict").otherwise("enriched")
    )
    return got.select(*(F.col(f"b.{k}").alias(k) for k in key), outcome.alias("outcome"))


def recover(targets: DataFrame, listed: DataFrame) -> DataFrame:
    """Each target stake among the stakes that its wallet had: found once, never or several times."""
    n = listed.groupBy("wallet", "stake").agg(F.count("*").alias("n"), F.min("locked_day").alias("locked_day"), F.min(F.col("shares").cast("string")).alias("shares"))
    got = targets.select("wallet", "stake").join(n, ["wallet", "stake"], "left")
    code = F.when(F.col("n").isNull(), "no_match").when(F.col("n") > 1, "multiple_match").when(F.col("locked_day") < 0, "invalid-locked-day").when(~F.col("shares").rlike("^[0-9]+$"), "invalid-stake-shares").otherwise("recovered")
    return got.select("wallet", "stake", code.alias("code"))


def contract_stakes(found: DataFrame, lists: DataFrame) -> DataFrame:
    """Contracts that hold one stake each: whole already, enriched from their stake list, or missing (no address or id)."""
    first = lists.where("place = 0").select("address", F.col("stake").alias("listed"))
    got = found.join(first, "address", "left")
    none = (F.col("address") == "0x" + "0" * 40) | F.col("listed").isNull() | (F.col("listed") == 0)
    return got.select("token", F.when(F.col("complete"), "skipped_already_complete").when(none, "missing").otherwise("enriched").alias("status"))


def ended_rollup(stakes: DataFrame) -> DataFrame:
    """Per wallet: ended stakes, whether all are whole, and their warnings in one list."""
    return stakes.groupBy("wallet").agg(F.count("*").alias("total"), F.bool_and("complete").alias("is_complete"), F.array_sort(F.flatten(F.collect_list("warnings"))).alias("warnings"))


def check_vector(rows: DataFrame, key: str, checks: dict[str, Column], hard: list[str]) -> DataFrame:
    """Every named check over all rows of a key, and PASS, WARN (a soft one fails) or FAIL (a hard one fails)."""
    got = rows.groupBy(key).agg(*(F.bool_and(c).alias(n) for n, c in checks.items()))
    fails = F.greatest(*(F.when(F.col(n), 0).otherwise(2 if n in hard else 1) for n in checks))
    return got.withColumn("verdict", F.when(fails == 2, "FAIL").when(fails == 1, "WARN").otherwise("PASS"))


def materialization_upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """State rows after an attempt: a failed one keeps the ranges and the time of the last success."""
    a, b = old.alias("a"), new.alias("b")
    got = a.join(b, F.col("a.wallet") == F.col("b.wallet"), "full")
    done, both = F.coalesce(F.col("b.status") == "COMPLETED", F.lit(False)), F.col("b.wallet").isNotNull()
    pick = lambda c: F.when(done, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c)
    return got.select(F.coalesce("a.wallet", "b.wallet").alias("wallet"), F.when(both, F.col("b.status")).otherwise(F.col("a.status")).alias("status"), pick("from_block"), pick("to_block"), F.coalesce("b.materialized_at", "a.materialized_at").alias("materialized_at"))


def diagnostics(states: DataFrame, balances: DataFrame, lp: DataFrame, stakes: DataFrame) -> DataFrame:
    """One row per wallet and chain of any table: its counts, block range and negative balances.

    A stored state gives the range; only without one do the positions' own ranges stand in.
    """
    key = ["wallet", "chain_id"]
    part = lambda df, kind: df.select(*key, F.lit(kind).alias("kind"), F.col("from_block") if "from_block" in df.columns else F.lit(None).cast("long").alias("from_block"), F.col("to_block") if "to_block" in df.columns else F.lit(None).cast("long").alias("to_block"), F.col("balance") if "balance" in df.columns else F.lit(None).cast("double").alias("balance"))  # noqa: E731, E501
    rows = part(states, "state").unionByName(part(balances, "token")).unionByName(part(lp, "lp")).unionByName(part(stakes, "stake"))
    n = lambda k: F.count_if(F.col("kind") == k)
    of = lambda f, c, state: f(F.when((F.col("kind") == "state") == F.lit(state), F.col(c)))
    got = rows.groupBy(*key).agg(
        n("token").alias("tokens"), n("lp").alias("lp"), n("stake").alias("stakes"), F.count_if(F.col("balance") < 0).alias("negative"), (n("state") > 0).alias("has_state"),
        of(F.min, "from_block", True).alias("s0"), of(F.max, "to_block", True).alias("s1"), of(F.min, "from_block", False).alias("p0"), of(F.max, "to_block", False).alias("p1"),
    )
    return got.select(*key, "tokens", "lp", "stakes", "negative", "has_state", F.when(F.col("has_state"), F.col("s0")).otherwise(F.col("p0")).alias("from_block"), F.when(F.col("has_state"), F.col("s1")).otherwise(F.col("p1")).alias("to_block"))


def ingestion_counts(blocks: DataFrame, transactions: DataFrame, logs: DataFrame) -> DataFrame:
    """Active blocks, transactions and logs that a wallet's scan has stored, in one row."""
    part = lambda df, name: df.where("status = 'ACTIVE'").select(F.lit(name).alias("kind"))
    rows = part(blocks, "blocks").unionByName(part(transactions, "transactions")).unionByName(part(logs, "logs"))
    return rows.agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("blocks", "transactions", "logs")))


def request_report(requests: DataFrame, now: Column) -> DataFrame:
    """Requests in all, those that failed within a day, and the time of the last."""
    recent = F.unix_micros("requested_at") >= F.unix_micros(now) - 86_400_000_000
    bad = (F.col("status_code") >= 400) | F.col("error").isNotNull()
    return requests.agg(F.count("*").alias("requests"), F.count_if(recent & F.coalesce(bad, F.lit(False))).alias("recent_errors"), F.max("requested_at").alias("latest"))


def composite(**reports: DataFrame) -> DataFrame:
    """Reports of one row or a few as ``(report, content)``, the content in JSON."""
    out = None
    for name, df in reports.items():
        one = df.select(F.lit(name).alias("report"), F.to_json(F.struct(*df.columns)).alias("content"))
        out = one if out is None else out.unionByName(one)
    return out


def ingested(results: DataFrame) -> DataFrame:
    """Of price requests per block: fetched, failed, and skipped as the route's own reference."""
    n = lambda c: F.count_if(c)
    skip = F.col("reason") == "pdai_routing_reference"
    return results.groupBy("block").agg(n(F.col("price").isNotNull()).alias("fetched"), n(F.coalesce(skip, F.lit(False)) & F.col("price").isNull()).alias("skipped"), n(F.col("price").isNull() & ~F.coalesce(skip, F.lit(False))).alias("failed"))


def live_valuation(assets: DataFrame) -> DataFrame:
    """Per wallet the exact value of priced balances, as text, null if none is; balances are raw integers of up to 78 digits.

    ``assets``: ``wallet, raw, decimals, price``; ``raw`` and ``price`` are text or numbers, a price has up to 18 places.
    """
    text = lambda c: F.col(c).cast("decimal(38,18)").cast("string") if assets.schema[c].dataType.typeName() in ("double", "float") else F.col(c).cast("string")
    # a raw integer has its point moved by its decimals, which an exponent says
    rows = assets.withColumns({"_amount": F.concat(text("raw"), F.lit("e-"), F.col("decimals").cast("string")), "_price": text("price")})
    rows = rows.withColumn("_value", wide.expr(wide.times("_amount", "_price")))
    got = wide.summed(rows, ["wallet"], {"total_value": "_value"}, F.count("*").alias("assets"), F.count("price").alias("valued"), places=2 * wide.PLACES)
    status = F.when(F.col("valued") == F.col("assets"), "available").when(F.col("valued") == 0, "unavailable").otherwise("partial")
    return got.select("wallet", "assets", "valued", "total_value", status.alias("status"))


def onboarding(wallets: DataFrame, runs: DataFrame, states: DataFrame, now: Column) -> DataFrame:
    """The state of each tracked wallet, from its newest run and its materialization; the first rule that holds."""
    last = runs.groupBy("wallet").agg(F.max_by(F.struct("status", "created_at", "updated_at", "warnings"), F.struct("created_at", "run")).alias("r"))
    got = wallets.join(last, "wallet", "left").join(states.select("wallet", F.struct("status", "success", "from_block", "to_block", "materialized_at", "warnings").alias("m")), "wallet", "left")
    run, mat, status = F.col("r"), F.col("m"), F.col("r.status")
    age = (F.unix_micros(now) - F.unix_micros("r.updated_at")) / 1_000_000
    stale = ((status == "PENDING") & (age > 900)) | ((status == "RUNNING") & (age > 3600))
    recorded = F.col("m.from_block").isNotNull() & F.col("m.to_block").isNotNull() & (F.col("m.from_block") <= F.col("m.to_block"))
    late = (status == "COMPLETED") & (F.col("m.materialized_at").isNull() | (F.col("m.materialized_at") < F.col("r.updated_at")))
    warned = F.coalesce("m.warnings", F.lit(0)) + F.coalesce("r.warnings", F.lit(0)) > 0
    no = lambda c: ~F.coalesce(c, F.lit(False))
    rules = [
        (run.isNull() & mat.isNull(), "TRACKED_NOT_SYNCED", True, False), (status.isin("PENDING", "RUNNING"), "SYNC_IN_PROGRESS", stale, False), (status == "FAILED", "SYNC_FAILED", True, False),
        (mat.isNull() | (F.col("m.status") == "RUNNING"), "CANONICAL_STATE_PARTIAL", False, False), (F.col("m.status") == "FAILED", "CANONICAL_STATE_PARTIAL", True, False),
        (no(F.col("m.success")), "CANONICAL_STATE_PARTIAL", False, False), (no(recorded), "CANONICAL_STATE_PARTIAL", False, True), (late, "CANONICAL_STATE_PARTIAL", False, True), (warned, "CANONICAL_STATE_WARNING", True, True),
    ]

    def chain(k: int, last_value):
        out = F.when(*[(c, F.lit(v) if not isinstance(v, Column) else v) for c, v in [(rules[0][0], rules[0][k])]][0])
        for rule in rules[1:]:
            v = rule[k]
            out = out.when(rule[0], v if isinstance(v, Column) else F.lit(v))
        return out.otherwise(F.lit(last_value))

    return got.select("wallet", chain(1, "CANONICAL_STATE_MATERIALIZED").alias("status"), chain(2, False).alias("action_required"), chain(3, True).alias("holdings_visible"))


def source_status(sources: DataFrame, prices: DataFrame, now: Column, disabled: list[str], own_quote: str, least: float = 0.5) -> DataFrame:
    """Per source with observations of the last seven days, and per enabled source without: state, counts and reason.

    A latest observation of an unverified quote outranks a stale one; confidence only counts as a rejection.
    """
    from ..functions.states import quote_unverified

    recent = prices.where(F.unix_micros("observed_at") >= F.unix_micros(now) - 7 * 86_400_000_000)
    stale = F.unix_micros("observed_at") + F.col("stale_after_seconds").cast("long") * 1_000_000 < F.unix_micros(now)
    bad_quote = quote_unverified(F.col("source_id"), F.col("quote"), own_quote)
    judged = recent.select("source_type", "observed_at", "price_id", stale.alias("stale"), bad_quote.alias("bad"), (stale | bad_quote | (F.col("confidence") < least)).alias("rejected"))
    got = judged.groupBy("source_type").agg(F.count("*").alias("n"), F.count_if("rejected").alias("rejected"), F.max_by(F.struct("stale", "bad"), F.struct("observed_at", "price_id")).alias("last"))
    got = sources.join(got, "source_type", "left")
    off, none = F.col("source_type").isin(disabled), F.col("n").isNull()
    reason = F.when(off, "source_disabled").when(none, "no_observations").when(F.col("last.bad"), "latest_observation_quote_ineligible").when(F.col("last.stale"), "latest_observation_stale")
    state = F.when(off, "disabled").when(none, "unknown").when(F.col("last.bad") | F.col("last.stale"), "degraded").otherwise("ok")
    counted = F.when(off, F.coalesce("n", F.lit(0))).otherwise(F.coalesce("rejected", F.lit(0)))
    return got.select("source_type", state.alias("status"), F.coalesce("n", F.lit(0)).alias("observations"), counted.alias("rejected"), reason.alias("reason"))


#: Reasons and sections in the order in which a report lists them.
REASONS = ["unpriced", "insufficient_cost_basis", "unsupported_position_type", "stale_price", "source_disabled"]
SECTIONS = ["summary", "tokens", "lpPositions", "stakePositions"]


def pnl_coverage(positions: DataFrame) -> DataFrame:
    """Per wallet the counts by fault of its positions, which may overlap, the reasons, sections and state.

    ``positions``: ``wallet, section, pnl, pricing, codes, rejected`` (arrays of warning codes and rejections).
    """
    token, has = F.col("section") == "tokens", lambda a, *v: F.arrays_overlap(F.col(a), F.array(*(F.lit(x) for x in v)))
    pnl, price = F.col("pnl"), F.col("pricing")
    faults = {
        "unpriced": token & ((pnl == "unavailable") | has("codes", "MARK_PRICE_UNAVAILABLE") | price.isin("unavailable", "low_confidence_price")),
        "insufficient_cost_basis": token & ((pnl == "incomplete_basis") | has("codes", "INSUFFICIENT_COST_BASIS", "COUNTER_ASSET_PRICE_UNAVAILABLE", "UNSUPPORTED_ACTION_GROUP", "UNRESOLVED_ECONOMIC_COUPLING")),
        "unsupported_position_type": pnl == "unsupported",
        "stale_price": token & ((pnl == "stale_price") | (price == "stale_price") | has("rejected", "STALE")),
        "source_disabled": token & has("rejected", "SOURCE_DISABLED"),
    }
    flagged = positions.select("wallet", "section", (token & (pnl == "available")).alias("priced"), *(F.coalesce(c, F.lit(False)).alias(n) for n, c in faults.items()))
    any_ = F.greatest(*(F.col(n) for n in REASONS))
    got = flagged.groupBy("wallet").agg(
        F.count("*").alias("positions"), F.count_if("priced").alias("priced"), *(F.count_if(n).alias(f"n_{n}") for n in REASONS), *(F.bool_or(any_ & (F.col("section") == s)).alias(f"s_{s}") for s in SECTIONS[1:])
    )
    affected = sum((F.col(f"n_{n}") for n in REASONS), F.lit(0))
    named = lambda names: F.concat_ws(",", *(F.when(c, n) for n, c in names))
    reasons = named([(n, F.col(f"n_{n}") > 0) for n in REASONS])
    sections = named([("summary", affected > 0), *((s, F.col(f"s_{s}")) for s in SECTIONS[1:])])
    state = F.when(affected == 0, "valued").when(F.col("n_unsupported_position_type") == F.col("positions"), "unsupported").when(F.col("priced") > 0, "partial").otherwise("unavailable")
    return got.select("wallet", "positions", "priced", *(F.col(f"n_{n}").alias(n) for n in REASONS), reasons.alias("reasons"), sections.alias("sections"), state.alias("status"))


#: Fixed values of candidate discovery.
CANDIDATE_CAP = 50


def candidates(balances: DataFrame, tokens: DataFrame, sources: DataFrame, lp: DataFrame, states: DataFrame, chain: int, reference: str, native: str, most: int = CANDIDATE_CAP) -> DataFrame:
    """Each balance row with the first reason against pricing it, else its place; wallets of unhealthy state have none.

    ``balances``: ``wallet, asset, address, decimals, balance, row``; ``tokens``: ``asset,
    ignored``; ``sources``: ``asset, decimals``; ``lp``: ``wallet, asset``; ``states``:
    ``wallet, healthy``.  Of repeated rows the first counts.
    """
    from ..functions.states import identity_fault

    seen = F.row_number().over(Window.partitionBy("wallet", "asset").orderBy("row"))
    kinds = sources.groupBy("asset").agg(F.min("decimals").alias("d0"), F.max("decimals").alias("d1"))
    got = balances.withColumn("n", seen).join(tokens, "asset", "left").join(kinds, "asset", "left").join(lp.select("wallet", "asset").distinct().withColumn("is_lp", F.lit(True)), ["wallet", "asset"], "left")
    conflict = F.col("ignored").isNotNull() & ((F.col("d0") != F.col("decimals")) | (F.col("d1") != F.col("decimals")))
    rules = [
        (F.col("n") > 1, "DUPLICATE_ASSET"), (identity_fault(F.col("asset"), F.lit(chain), F.col("address")).isNotNull(), "INVALID_CANONICAL_IDENTITY"), (F.col("balance") == 0, "ZERO_BALANCE"),
        (F.col("decimals").isNull(), "MISSING_DECIMALS"), (~F.col("decimals").between(0, 18), "INVALID_DECIMALS"), (F.col("asset") == reference, "PDAI_ROUTING_REFERENCE"),
        (F.col("is_lp"), "UNSUPPORTED_ASSET_CLASS"), (F.col("ignored"), "IGNORED_ASSET"), (conflict, "CONFLICTING_DECIMALS"),
    ]
    reason = F.when(*rules[0])
    for rule in rules[1:]:
        reason = reason.when(*rule)
    got = got.withColumn("reason", reason).join(states, "wallet", "left").withColumn("healthy", F.coalesce("healthy", F.lit(False)))
    place = F.row_number().over(Window.partitionBy("wallet", F.col("reason").isNull()).orderBy(F.desc(F.col("asset") == native), "asset"))
    place = F.when(F.col("reason").isNull() & F.col("healthy"), place)
    return got.select("wallet", "asset", "row", "healthy", "reason", place.alias("place"), F.coalesce(place <= most, F.lit(False)).alias("chosen"))

"""Column functions that judge: statuses, reasons and classes of ledger facts, first matching rule first."""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The chain, its fork, its native asset, the quoted routes, the staking contract's day of extra pay.
CHAIN = 369
LAST_INHERITED, FIRST_OWN = 17_232_999, 17_233_000
NATIVE_ADDRESS = "0x0000000000000000000000000000000000000000"
NATIVE_ASSET = f"chain:{CHAIN}:native:{NATIVE_ADDRESS}"
ROUTE_PATTERN = "^pulsex:(pulsex_v1|pulsex_v2):route:"
PAR_SOURCE = "pulsex:pdai:par"
EXTRA_PAY_DAY = 353
#: Words of provider errors, in the order in which they are looked for, and whether to try again.
FAILURES = {
    "rate_limited": ["rate limit", "too many requests"], "timeout": ["timeout", "timed out", "aborted"],
    "network_unreachable": ["enotfound", "econnrefused", "failed to fetch", "networkerror"],
    "provider_unavailable": ["service unavailable", "bad gateway", "gateway timeout"],
    "invalid_response": ["invalid json", "malformed", "invalid response"], "execution_reverted": ["execution reverted", "reverted"],
    "block_range_too_large": ["block range", "query returned more than", "too many blocks"],
    "provider_disagreement": ["provider disagreement", "inconsistent provider result"],
}
RETRYABLE = ["rate_limited", "timeout", "network_unreachable", "provider_unavailable", "block_range_too_large"]
CODES = {429: "rate_limited", 502: "provider_unavailable", 503: "provider_unavailable", 504: "provider_unavailable"}
#: Warning codes of average-cost accounting by what they make of a position.
INCOMPLETE = ["COUNTER_ASSET_PRICE_UNAVAILABLE", "INSUFFICIENT_COST_BASIS", "UNSUPPORTED_ACTION_GROUP", "UNRESOLVED_ECONOMIC_COUPLING"]
UNSUPPORTED = ["UNSUPPORTED_LP_ACTION", "UNSUPPORTED_STAKE_ACTION"]


def _first(rules: list[tuple[Column, object]], other=None) -> Column:
    out = reduce(lambda acc, r: acc.when(r[0], r[1]), rules[1:], F.when(*rules[0]))
    return out if other is None else out.otherwise(other)


def fork_provenance(chain: Column, block: Column) -> Column:
    """Whether a block was inherited at the fork or made after it."""
    rules = [((chain != CHAIN) | (block < 0), "UNKNOWN_OR_UNVERIFIED"), (block <= LAST_INHERITED, "ETHEREUM_INHERITED_HISTORY"), (block >= FIRST_OWN, "PULSECHAIN_POST_FORK")]
    return _first(rules, "UNKNOWN_OR_UNVERIFIED")


def identity_fault(asset: Column, chain: Column, address: Column) -> Column:
    """First fault of an asset id against its chain and stored address; null if it is canonical."""
    pattern = r"^chain:([0-9]+):(erc20|native):(0x[0-9a-f]{40})$"
    part = lambda k: F.regexp_extract(asset, pattern, k)
    native = part(2) == "native"
    return _first([
        (~asset.rlike(pattern), "malformed"), (part(1) != chain.cast("string"), "other-chain"), (native & (asset != NATIVE_ASSET), "not-the-native-asset"),
        (~native & address.isNull(), "no-address"), (~native & (part(3) != F.lower(address)), "other-address"),
    ])


def quote_unverified(source_id: Column, quote: Column, own_quote: str) -> Column:
    """An observation that a route or an assumed parity made counts only under the route's own quote asset."""
    return (source_id == PAR_SOURCE) | (source_id.rlike(ROUTE_PATTERN) & (F.lower(quote) != own_quote))


def active_stake(chain: Column, source: Column, status: Column, locked: Column, days: Column, now: Column) -> Column:
    whole = locked.isNotNull() & days.isNotNull() & (days > 0)
    return F.coalesce((chain == CHAIN) & (source == "native") & (status != "ended") & whole & (locked <= now) & (now < locked + days), F.lit(False))


def stake_status(now: Column, locked: Column, days: Column) -> Column:
    return _first([(now.isNull(), "unknown"), (locked > now, "pending"), (now >= locked + days, "overdue")], "active")


def extra_pay(locked: Column, days: Column, unresolved: Column) -> Column:
    """Whether a stake's days hold the day of extra pay; unknown while its share is unresolved."""
    return _first([(unresolved, "unknown"), ((locked <= EXTRA_PAY_DAY) & (locked + days > EXTRA_PAY_DAY), "applicable")], "not_applicable")


def principal_text(units: Column) -> Column:
    """Units of 10^-8 with all eight places."""
    return (units.cast("decimal(30,0)") / F.lit(100_000_000).cast("decimal(9,0)")).cast("decimal(30,8)").cast("string")


def share_text(shares: Column) -> Column:
    """Shares in units of 10^12, to six places, half up, zeros stripped."""
    from .scalars import trim_decimal

    return trim_decimal(F.round(shares.cast("decimal(30,0)") / F.lit(str(10**12)).cast("decimal(13,0)"), 6).cast("decimal(30,6)").cast("string"))


def display_units(units: Column) -> Column:
    """A digit string of units of 10^-8 as shown: no zeros at the end; null for other text."""
    from .scalars import canonical_quantity

    return canonical_quantity(units, F.lit(8))


def gas_fee(price: Column, used: Column) -> Column:
    return price.cast("decimal(19,0)") * used.cast("decimal(18,0)")


def pool_price(out: Column) -> Column:
    """Price from the amount out of 10^18 units."""
    return out.cast("decimal(38,0)") / F.lit(str(10**18)).cast("decimal(19,0)")


def pool_liquidity(reserve: Column, decimals: Column, price: Column) -> Column:
    """Twice the value of one side's reserve."""
    return reserve.cast("double") / F.pow(F.lit(10.0), decimals) * price.cast("double") * 2


def coverage_status(low: Column, high: Column) -> Column:
    """Of a recorded block range: both ends, one, or none."""
    return _first([(low.isNotNull() & high.isNotNull(), "covered"), (low.isNotNull() | high.isNotNull(), "partial")], "unknown")


def pricing_status(selected: Column, reasons: Column) -> Column:
    """Of a price request: what was chosen, else the first reason that counts."""
    has = lambda r: F.array_contains(reasons, r)
    return _first([(selected.isNotNull(), "available"), (has("STALE"), "stale_price"), (has("LOW_CONFIDENCE"), "low_confidence_price")], "unavailable")


def pnl_status(codes: Column, valuation: Column) -> Column:
    """Of a position's accounting, from its warning codes and how its price stands."""
    any_of = lambda names: F.arrays_overlap(codes, F.array(*(F.lit(n) for n in names)))
    mark = F.when(valuation.isin("stale_price", "low_confidence_price"), valuation).otherwise("unavailable")
    return _first([(any_of(INCOMPLETE), "incomplete_basis"), (any_of(UNSUPPORTED), "unsupported"), (F.array_contains(codes, "MARK_PRICE_UNAVAILABLE"), mark)], "available")


def parsed_warning(text: Column) -> Column:
    """``code, asset, quantity`` of a stored warning; the quantity follows the last colon."""
    pattern = "^negative-token-balance:(.+):([^:]+)$"
    hit = text.rlike(pattern)
    part = lambda k: F.when(hit, F.regexp_extract(text, pattern, k))
    return F.struct(F.when(hit, "negative_token_balance").otherwise("materialization_warning").alias("code"), part(1).alias("asset"), part(2).alias("quantity"))


def entry_flags(value: Column) -> list[Column]:
    known = value.isNotNull()
    return [F.when(known, "priced").otherwise("unavailable").alias("pricing_status"), F.when(known, "valued").otherwise("unavailable").alias("valuation_status"), F.when(known, "fiat:usd").alias("quote_asset")]


def provider_failure(message: Column, code: Column) -> Column:
    """Class of a provider's error by its status code or the first word found."""
    text = F.lower(message)
    rules = []
    for name, words in FAILURES.items():
        hit = reduce(Column.__or__, (text.contains(w) for w in words))
        numbers = [n for n, c in CODES.items() if c == name]
        rules.append(((code.isin(numbers) | hit) if numbers else hit, name))
    return _first([(F.coalesce(c, F.lit(False)), n) for c, n in rules], "unknown")


def retry_decision(failure: Column, attempt: Column, most: int) -> Column:
    rules = [(failure == "unknown", "unknown_failure_not_retryable"), (~failure.isin(RETRYABLE), "failure_not_retryable"), (attempt >= most, "max_attempts_reached"), (failure == "block_range_too_large", "block_range_too_large")]
    return _first(rules, "retryable_failure")


def retry_delay(attempt: Column, base: int, most: int) -> Column:
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempt), F.lit(float(most))).cast("long")


def sync_error(name: Column, message: Column) -> Column:
    text = F.lower(F.concat_ws(" ", name, message))
    has = lambda *words: reduce(Column.__or__, (text.contains(w) for w in words))
    net = ("network", "connect", "connection", "enotfound", "econnrefused", "econnreset")
    return _first([(has("contractfunctionexecutionerror"), "contract_function_execution_error"), (has("timeout", "timed out"), "timeout_error"), (has(*net), "network_error")], "unexpected_error")


def redacted(message: Column, most: int = 300) -> Column:
    """A message without addresses of services, in single spaces, cut at ``most`` characters."""
    text = F.trim(F.regexp_replace(F.regexp_replace(message, r"(?i)\b[a-z][a-z0-9+.-]*://\S+", "[redacted-url]"), r"\s+", " "))
    return F.when(F.length(text) > most, F.concat(F.substr(text, F.lit(1), F.lit(most)), F.lit("…"))).otherwise(text)


def evidence_reason(found_from: Column, found_to: Column, low: Column, high: Column, invalidated: Column, valid: Column) -> Column:
    """Why a range has no evidence; null if it is covered."""
    return _first([
        (found_from.isNull(), "missing_exact_observation"), ((found_from != low) | (found_to != high), "evidence_range_mismatch"),
        (invalidated, "invalidated_observation"), (~valid, "invalid_observation_payload"),
    ])


def stake_call(data: Column) -> Column:
    """``kind, principal (hexadecimal word), days, stake_index, stake_id`` of a call's data, by its selector and words."""
    selector, word = F.substr(F.lower(data), F.lit(1), F.lit(10)), lambda k: F.substr(data, F.lit(11 + 64 * k), F.lit(64))
    #: Selectors of stakeStart(uint256,uint256) and stakeEnd(uint256,uint40).
    start, end = (selector == "0x52a438b8") & (F.length(data) >= 138), (selector == "0x343009a2") & (F.length(data) >= 138)
    small = lambda w: F.conv(F.substr(w, F.lit(50), F.lit(15)), 16, 10).cast("long")
    kind = _first([(data.isNull() | (data == "0x"), "missing-input"), (start, "START"), (end, "END")], "unsupported-selector")
    return F.struct(kind.alias("kind"), F.when(start, word(0)).alias("principal"), F.when(start, small(word(1))).alias("days"), F.when(end, small(word(0))).alias("stake_index"), F.when(end, small(word(1))).alias("stake_id"))


def renamed_asset(items: Column, old: str, new: str) -> Column:
    """JSON items with one asset id for another."""
    return F.transform(items, lambda x: F.replace(x, F.lit(old), F.lit(new)))


def scaled18(text: Column) -> Column:
    """A decimal text as an integer of 10^-18; more than 18 places are an error."""
    places = F.length(F.regexp_extract(text, r"\.([0-9]*)$", 1))
    bad = F.raise_error(F.concat(F.lit("more than 18 places: "), text)).cast("decimal(38,0)")
    return F.when(places > 18, bad).otherwise((text.cast("decimal(38,18)") * F.lit(str(10**18)).cast("decimal(19,0)")).cast("decimal(38,0)"))


def _payload_code(text: str | None) -> str | None:
    """First fault of a payload of daily data; null if it is sound."""

    def number(x) -> bool:
        if isinstance(x, dict):
            return any(map(number, x.values()))
        if isinstance(x, list):
            return any(map(number, x))
        return isinstance(x, (int, float)) and not isinstance(x, bool)

    try:
        got = json.loads(text)
    except (TypeError, ValueError):
        return "invalid-json"
    if number(got):
        return "numeric-json-value"
    if not isinstance(got, dict):
        return "invalid-root"
    if "schemaVersion" not in got:
        return "missing-schema-version"
    if got["schemaVersion"] != "v1":
        return "unsupported-schema-version"
    if "dailyData" not in got:
        return "missing-daily-data"
    if not isinstance(got["dailyData"], list):
        return "daily-data-not-array"
    for k, x in enumerate(got["dailyData"]):
        if not isinstance(x, str):
            return f"item-not-string-at-{k}"
        if not (x.isascii() and x.isdigit()):
            return f"item-invalid-at-{k}"
    return None


@F.pandas_udf(T.StringType())
def payload_code(payload: pd.Series) -> pd.Series:
    """The order of the checks crosses types that a JSON schema cannot hold, so it takes Python, in batches."""
    return payload.map(_payload_code)

"""Column functions of the ledger: quantities, identities, bands and packed words."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the ledger's vocabulary.
LP_TYPES = ["LP_ADD", "LP_REMOVE"]
STAKE_TYPES = ["HEX_STAKE_START", "HEX_STAKE_END", "HEX_STAKE_LOCK"]
ACTION_PRIORITY = ["HEX_STAKE_END", "HEX_STAKE_START", "HEX_STAKE_LOCK", "SWAP", "LP_ADD", "LP_REMOVE", "TRANSFER"]
SOURCE_PRIORITY = {"ONCHAIN_POOL": 5, "ONCHAIN_ROUTE": 4, "ORACLE": 3, "MANUAL": 2}
MAX_PACKED = (1 << 200) - 1


def canonical_quantity(raw: Column, decimals: Column) -> Column:
    """Digit string shifted by ``decimals`` places, zeros at the end stripped; null unless digits and non-negative."""
    digits = F.regexp_replace(raw, "^0+(?=[0-9])", "")
    padded = F.lpad(digits, F.greatest(F.length(digits), decimals + 1), F.lit("0"))
    whole = F.substring(padded, F.lit(1), F.length(padded) - decimals)
    part = F.regexp_replace(F.substring(padded, F.length(padded) - decimals + 1, decimals), "0+$", "")
    shown = F.when(part == "", whole).otherwise(F.concat(whole, F.lit("."), part))
    return F.when(raw.rlike("^[0-9]+$") & (decimals >= 0), shown)


def trim_decimal(text: Column) -> Column:
    """``1.500`` as ``1.5`` and ``2.000`` as ``2``."""
    return F.regexp_replace(F.regexp_replace(text, r"\.0+$", ""), r"(\.[0-9]*?)0+$", "$1")


def content_id(prefix: str, *columns: Column | str) -> Column:
    """Prefix and SHA-256 of the columns as one JSON object, nulls kept."""
    return F.concat(F.lit(prefix), F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256))


def asset_id(chain: Column, address: Column) -> Column:
    return F.concat(F.lit("chain:"), chain.cast("string"), F.lit(":erc20:"), F.lower(address))


def asset_address(asset: Column) -> Column:
    """The address of an ERC-20 asset id; null for others."""
    return F.nullif(F.regexp_extract(asset, r"^chain:[0-9]+:erc20:(0x[0-9a-f]{40})$", 1), F.lit(""))


def stake_key(source: Column) -> Column:
    return F.nullif(F.regexp_extract(source, r"(?i)stake:(?:start|end):([^:]+)", 1), F.lit(""))


def liquidity_confidence(liquidity: Column) -> Column:
    bands = ((1_000_000, 0.95), (100_000, 0.85), (10_000, 0.70), (1_000, 0.55))
    out = F.when(liquidity.isNull(), F.lit(0.50))
    for low, confidence in bands:
        out = out.when(liquidity >= low, F.lit(confidence))
    return out.otherwise(F.lit(0.30))


def stake_split(locked: Column, total: Column) -> list[Column]:
    """``principal, yield, penalty`` of a stake's end; a zero yield or penalty is unknown (null)."""
    none = F.lit(None).cast("double")
    return [
        F.least(total, locked).alias("principal"),
        F.when(total > locked, total - locked).otherwise(none).alias("yield_"),
        F.when(locked > total, locked - total).otherwise(none).alias("penalty"),
    ]


def source_family(action: Column) -> Column:
    """Family of a type of action; null for others."""
    return F.when(action == "TRANSFER", "TRANSFERS").when(action == "SWAP", "DEX").when(action.isin(LP_TYPES), "LP").when(action.isin(STAKE_TYPES), "STAKING")


@F.pandas_udf(T.StructType([T.StructField(c, T.StringType()) for c in ("payout", "shares", "sats", "error")]))
def decode_packed(packed: pd.Series) -> pd.DataFrame:
    """Bits 0-71, 72-143 and 144-199 of a decimal digit string; integers of this width need Python."""

    def one(text):
        if text is None or not text.removeprefix("-").isdigit():
            return None, None, None, "malformed"
        value = int(text)
        if value < 0:
            return None, None, None, "negative"
        if value > MAX_PACKED:
            return None, None, None, "exceeds-max"
        low = (1 << 72) - 1
        return str(value & low), str(value >> 72 & low), str(value >> 144), None

    return pd.DataFrame([one(x) for x in packed], columns=["payout", "shares", "sats", "error"])


@F.pandas_udf(T.StringType())
def hex_to_digits(word: pd.Series) -> pd.Series:
    """A hexadecimal word of any width as a digit string."""
    return word.map(lambda x: None if x is None else str(int(x, 16)), na_action="ignore")

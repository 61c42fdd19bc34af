"""Average-cost profit and loss of single legs: an ordered fold per wallet and asset, as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


_FOLDED = "holdings double, avg_cost double, realized double, skipped long"


def _fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    key, state, out = None, None, []
    names = ["wallet", "asset", "holdings", "avg_cost", "realized", "skipped"]

    def close():
        h, c, r, s = state
        out.append((*key, h, c / h if h != 0 else None, r, s))

    for frame in frames:
        for wallet, asset, direction, quantity, value in zip(*(frame[c].tolist() for c in ("wallet", "asset", "direction", "quantity", "value")), strict=True):
            if (wallet, asset) != key:
                if key is not None:
                    close()
                key, state = (wallet, asset), [0.0, 0.0, 0.0, 0]
            h, c, r, s = state
            if direction != "OUT":
                state = [h + quantity, c + value, r, s]
            elif quantity > h:
                state = [h, c, r, s + 1]
            else:
                taken = c / (h or 1.0) * quantity
                state = [h - quantity, c - taken, r + (value - taken), s]
        if out:
            yield pd.DataFrame(out, columns=names)
            out.clear()
    if key is not None:
        close()
        yield pd.DataFrame(out, columns=names)


def average_cost(legs: DataFrame, order: list[str]) -> DataFrame:
    """``wallet, asset, holdings, avg_cost, realized, skipped``.

    ``legs`` has ``wallet, asset, direction, quantity, value``.  Legs are folded in the order
    of the columns ``order``.  An IN leg adds its value to the cost; an OUT leg takes cost at
    the average and realises the difference; one beyond the holdings is skipped and counted.
    Each fold depends on the one before, so a key is one task's; it reads its legs as a
    stream that Spark has sorted, and holds four numbers, however long the history.
    """
    kinds = {f.name: f.dataType.simpleString() for f in legs.schema.fields}
    ordered = legs.select("wallet", "asset", *[c for c in order if c not in ("quantity", "value")], "direction", "quantity", "value").repartition("wallet", "asset").sortWithinPartitions("wallet", "asset", *order)
    return ordered.select("wallet", "asset", "direction", "quantity", "value").mapInPandas(_fold, f"wallet {kinds['wallet']}, asset {kinds['asset']}, {_FOLDED}")


def coupled(legs: DataFrame) -> DataFrame:
    """Legs that another leg of their transaction answers: other direction and asset, quantity not zero."""
    other = legs.where("quantity != 0 and entry_type != 'FEE'").select(F.col("tx"), F.col("asset").alias("a"), F.col("direction").alias("d")).distinct()
    return legs.alias("l").join(other.alias("o"), (F.col("l.tx") == F.col("o.tx")) & (F.col("asset") != F.col("a")) & (F.col("direction") != F.col("d")), "left_semi")


def status(folded: DataFrame) -> DataFrame:
    """``status`` per wallet and asset: complete, partial (some legs skipped) or empty."""
    return folded.withColumn("status", F.when(F.col("skipped") > 0, "partial").when(F.col("holdings") == 0, "empty").otherwise("complete"))


def coverage(folded: DataFrame) -> DataFrame:
    """Counts by status of each wallet."""
    n = lambda s: F.count_if(F.col("status") == s)
    return status(folded).groupBy("wallet").agg(F.count("*").alias("positions"), n("complete").alias("complete"), n("partial").alias("partial"), n("empty").alias("empty"), F.sum("skipped").alias("skipped_legs"))

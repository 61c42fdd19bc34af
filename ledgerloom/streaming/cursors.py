"""Sync cursors as a stream: one state per wallet, chain and family, which windows extend in their order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

KEY = ["wallet", "chain_id", "family"]
_OUT = "wallet string, chain_id int, family string, seq long, outcome string, from_block long, to_block long, block_hash string"
_STATE = "from_block long, to_block long, block_hash string, seq long"


def merged_window(state: tuple | None, low: int, high: int, block_hash: str | None) -> tuple[str, tuple | None]:
    """Outcome and the cursor ``(from, to, hash)`` after a window.

    The first window makes the cursor.  After that it moves forward only with the hash of its
    new last block (else ``refused``) and joins only windows that touch it (else
    ``disconnected``); a window inside it changes nothing.
    """
    if state is None:
        return "created", (low, high, block_hash)
    lo, hi, known = state
    if high > hi and block_hash is None:
        return "refused", state
    if low > hi + 1 or high + 1 < lo:
        return "disconnected", state
    if high <= hi and low >= lo:
        return "unchanged", state
    return "merged", (min(lo, low), max(hi, high), block_hash if high > hi else known)


def advanced(windows: DataFrame) -> DataFrame:
    """One row per window of the stream: its outcome and the cursor after it.

    ``windows``: ``wallet, chain_id, family, seq, from_block, to_block, block_hash``.  A key's
    windows are taken in the order of ``seq`` within a batch; one whose ``seq`` is not above
    the last one taken was seen before, or comes too late, and is ``stale``.  Only a cursor's
    three values and its last ``seq`` are kept, in the checkpoint, without expiry: a stream that
    starts again goes on where it was.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        cursor, last = None, -1
        if state.exists:
            *held, last = state.get
            cursor = tuple(held)
        out = []
        for seq, low, high, block_hash in zip(rows["seq"], rows["from_block"], rows["to_block"], rows["block_hash"], strict=True):
            outcome = "stale"
            if seq > last:
                outcome, cursor = merged_window(cursor, int(low), int(high), None if pd.isna(block_hash) else block_hash)
                last = int(seq)
            out.append((*key, int(seq), outcome, *cursor))
        state.update((*cursor, last))
        yield pd.DataFrame(out, columns=[*KEY, "seq", "outcome", "from_block", "to_block", "block_hash"])

    return windows.groupBy(*KEY).applyInPandasWithState(step, _OUT, _STATE, "update", GroupStateTimeout.NoTimeout)

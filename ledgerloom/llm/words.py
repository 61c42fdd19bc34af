"""Words of many texts at once, on the UTF-8 bytes of an Arrow column.

Both word definitions in use split at ASCII bytes only, and every byte of a non-ASCII
character is part of a word, so byte positions give the same words as characters do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Words between ASCII white space: ``[^\x20\x09-\x0D]+``.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False

#: Letters, digits and everything beyond ASCII: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_random = np.random.default_rng(20240229)
_VALUE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = np.ones((2, 1), np.uint64)


def _power_table(n: int) -> np.ndarray:
    """Powers of the base and of its inverse, modulo 2**64."""
    global _powers
    while _powers.shape[1] < n:
        k = _powers.shape[1]
        step = np.array([[pow(_BASE, k, 1 << 64)], [pow(_INVERSE, k, 1 << 64)]], np.uint64)
        _powers = np.concatenate([_powers, _powers * step], axis=1)
    return _powers[:, :n]


def forget() -> None:
    """Drop the table of powers, which is as long as the longest text met."""
    global _powers
    _powers = np.ones((2, 1), np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null counts as empty."""
    flat = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = flat.buffers()
    at = np.frombuffer(offsets, np.int64)[flat.offset : flat.offset + len(flat) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at


def pieces(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, last row, bytes, offsets from 0)`` of runs of whole texts of about ``limit`` bytes."""
    raw, at = buffers(column)
    i = 0
    while i < len(at) - 1:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, side="right")) - 1)
        yield i, j, raw[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def spans(raw: np.ndarray, at: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and for each text the number of words before it."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    mark = inside[raw]
    begins, ends = mark.copy(), mark.copy()
    begins[1:] &= ~mark[:-1]
    ends[:-1] &= ~mark[1:]
    edge = at[:-1][at[:-1] < len(raw)]
    begins[edge] = mark[edge]
    last = edge[edge > 0] - 1
    ends[last] = mark[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, at)


def hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of every word: a polynomial in its bytes, then mixed with the length."""
    if not len(start):
        return np.zeros(0, np.uint64)
    power, inverse = _power_table(len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_VALUE[raw] * power, out=total[1:])
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


def shingles(word: np.ndarray, first: int, last: int, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word runs of one text; a shorter text is one run."""
    w = word[first:last]
    if len(w) == 0:
        return w
    k = min(n, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = mix(h * np.uint64(_BASE) + w[i : len(w) - k + 1 + i])
    return np.unique(h)

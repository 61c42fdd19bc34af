"""Benchmark decontamination with suffix arrays of the training text.

The documents are cut into shards of a few megabytes, where they lie.  Each shard sorts its
word suffixes into a suffix array and every test suffix is binary-searched in it, word by
word, so matches come with their places.  Nothing is shuffled: the test items travel to the
shards, in blocks of bounded size, and a document's verdict leaves with its row.
"""

from __future__ import annotations

import hashlib
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import freed, small_batches

def _gap(n: int) -> int:
    """Symbols that match nothing, after each document and item: more than any search reads on."""
    return n + 1


class ItemWindows:
    """The windows of one block of items, as sequences of word numbers; 0 is a word that no item has."""

    def __init__(self, ids: list, texts: list, n: int, tails: bool = False):
        """``tails`` adds the suffixes of fewer than ``n`` words at the ends of items."""
        gap = self.gap = _gap(n)
        raw, at = words.buffers(pa.array(texts, pa.string()))
        raw = words.LOWER[raw]
        start, end, first = words.spans(raw, at, words.ALNUM)
        h = words.hashes(raw, start, end)
        self.vocabulary = np.unique(h)
        self.present = np.zeros(1 << 20, bool)
        self.present[(self.vocabulary >> np.uint64(44)).astype(np.int64)] = True
        number = np.searchsorted(self.vocabulary, h).astype(np.int64) + 1
        size = np.diff(first)
        self.n, self.ids = n, ids
        # one place for items of the same words; the others only lend their id
        symbols, self.owners, self.base, places = [], [], [], {}
        begin, length, item, used = [], [], [], 0
        for k in range(len(texts)):
            own = number[first[k] : first[k + 1]]
            if not size[k]:
                continue
            key = own.tobytes()
            if key in places:
                self.owners[places[key]].append(k)
                continue
            places[key] = len(self.owners)
            self.owners.append([k])
            self.base.append(used)
            used += len(own) + gap
            symbols += [own, np.zeros(gap, np.int64)]
            w = min(n, len(own))
            for s in range(len(own) if tails else len(own) - w + 1):
                begin.append(self.base[-1] + s)
                length.append(min(w, len(own) - s))
                item.append(places[key])
        self.symbols = np.concatenate(symbols) if symbols else np.zeros(gap, np.int64)
        self.begin, self.length, self.item = (np.array(x, np.int64) for x in (begin, length, item))
        # windows of equal words are searched once
        grid = self.symbols[np.minimum(self.begin[:, None] + np.arange(n), len(self.symbols) - 1)]
        grid[np.arange(n) >= self.length[:, None]] = 0
        self.windows, which = np.unique(grid, axis=0, return_inverse=True)
        which = which.reshape(-1)
        self.by_window = np.argsort(which, kind="stable")
        self.window_at = np.searchsorted(which[self.by_window], np.arange(len(self.windows) + 1))
        self.window_size = (self.windows > 0).sum(1)

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """Word numbers of hashed training words."""
        out = np.zeros(len(h), np.int64)
        maybe = np.flatnonzero(self.present[(h >> np.uint64(44)).astype(np.int64)])
        if len(maybe) and len(self.vocabulary):
            k = np.minimum(np.searchsorted(self.vocabulary, h[maybe]), len(self.vocabulary) - 1)
            out[maybe] = np.where(self.vocabulary[k] == h[maybe], k + 1, 0)
        return out


def suffix_array(symbols: np.ndarray, depth: int, largest: int) -> np.ndarray:
    """Places of the suffixes that begin with a test word, sorted by their first ``depth`` symbols.

    Several symbols share one 64-bit key, so a few stable sorts order the suffixes.  The
    last ``depth`` symbols must be a gap of zeros.
    """
    bits = max(1, int(largest).bit_length())
    per = max(1, 63 // bits)
    places = np.flatnonzero(symbols > 0)
    keys = []
    for low in range(0, depth, per):
        key = np.zeros(len(places), np.int64)
        for k in range(low, min(low + per, depth)):
            key = (key << bits) | symbols[places + k]
        keys.append(key)
    return places[np.lexsort(keys[::-1])]


def search(symbols: np.ndarray, order: np.ndarray, windows: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every window the range of the suffix array whose suffixes begin with it, how many of its words match, and where.

    All windows are searched together; at each depth their ranges narrow by two binary
    searches on one more word, and windows whose range is empty leave.
    """
    low, high = np.zeros(len(windows), np.int64), np.full(len(windows), len(order), np.int64)
    depth, at = np.zeros(len(windows), np.int64), np.zeros(len(windows), np.int64)
    for d in range(windows.shape[1]):
        live = np.flatnonzero((high > low) & (size > d))
        if not len(live):
            break
        want = windows[live, d]
        for side in (0, 1):
            a, b = low[live].copy(), high[live].copy()
            while len(open_ := np.flatnonzero(a < b)):
                mid = (a[open_] + b[open_]) >> 1
                got = symbols[order[mid] + d]
                right = got < want[open_] if side == 0 else got <= want[open_]
                a[open_[right]] = mid[right] + 1
                b[open_[~right]] = mid[~right]
            if side == 0:
                left = a
            else:
                low[live], high[live] = left, a
        deeper = live[high[live] > low[live]]
        depth[deeper], at[deeper] = d + 1, order[low[deeper]]
    return low, high, depth, at


def _symbols(test: ItemWindows, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word counts of a shard's documents, its word numbers with gaps, and where each document begins in them."""
    raw = words.LOWER[raw]
    start, end, first = words.spans(raw, at, words.ALNUM)
    count = np.diff(first)
    doc = np.repeat(np.arange(len(count)), count)
    place = np.arange(len(start)) + doc * test.gap
    symbols = np.zeros(len(start) + (len(count) + 1) * test.gap, np.int64)
    symbols[place] = test.numbers(words.hashes(raw, start, end))
    return count, symbols, first[:-1] + np.arange(len(count)) * test.gap


def _longest(test: ItemWindows, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every suffix of the items its longest match in a shard: words, document and place, the first of equals."""
    _, symbols, origin = _symbols(test, raw, at)
    order = suffix_array(symbols, max(test.n, 1), len(test.vocabulary))
    low, high, depth, where = search(symbols, order, test.windows, test.window_size)
    which = np.empty(len(test.begin), np.int64)
    which[test.by_window] = np.repeat(np.arange(len(test.windows)), np.diff(test.window_at))
    length, place = depth[which], where[which]
    # whole windows go on, word by word, at each place where they stand
    full = np.flatnonzero(depth[which] == test.n)
    times = (high - low)[which[full]]
    pair = np.repeat(full, times)
    hit = order[np.repeat(low[which[full]], times) + np.arange(len(pair)) - np.repeat(np.cumsum(times) - times, times)]
    size, live, d = np.full(len(pair), test.n), np.arange(len(pair)), test.n
    while len(live):
        p, t = np.minimum(hit[live] + d, len(symbols) - 1), np.minimum(test.begin[pair[live]] + d, len(test.symbols) - 1)
        live = live[(symbols[p] > 0) & (symbols[p] == test.symbols[t])]
        d += 1
        size[live] = d
    best = np.lexsort((hit, -size, pair))
    head = best[np.unique(pair[best], return_index=True)[1]] if len(pair) else best
    length[pair[head]], place[pair[head]] = size[head], hit[head]
    doc = np.searchsorted(origin, place, side="right") - 1
    return length, doc, place - origin[np.maximum(doc, 0)]


def _shard(test: ItemWindows, raw: np.ndarray, at: np.ndarray):
    """Per document of a shard: word count, hit spans, items, and its longest match."""
    count, symbols, origin = _symbols(test, raw, at)
    spans: list[list] = [[] for _ in count]
    items: list[set] = [set() for _ in count]
    longest: list[tuple] = [(0, None, None, None)] * len(count)
    if len(test.windows):
        order = suffix_array(symbols, max(test.n, 1), len(test.vocabulary))
        low, high, _, _ = search(symbols, order, test.windows, test.window_size)
        times = high - low
        found = np.repeat(np.arange(len(times)), times)
        hit = order[np.repeat(low, times) + np.arange(len(found)) - np.repeat(np.cumsum(times) - times, times)]
        by = np.argsort(hit, kind="stable")
        hit, found = hit[by], found[by]
        owner = np.searchsorted(origin, hit, side="right") - 1
        # spans of hit words
        delta = np.zeros(len(symbols) + 1, np.int64)
        np.add.at(delta, hit, 1)
        np.add.at(delta, hit + test.window_size[found], -1)
        covered = np.concatenate([[0], (np.cumsum(delta) > 0).astype(np.int8), [0]])
        for a, b in zip(np.flatnonzero(np.diff(covered) == 1).tolist(), np.flatnonzero(np.diff(covered) == -1).tolist(), strict=True):
            d = int(np.searchsorted(origin, a, side="right")) - 1
            spans[d].append((a - int(origin[d]), b - int(origin[d])))
        # items, from distinct pairs of document and window
        pairs = np.unique(owner * np.int64(len(test.windows)) + found)
        for d, w in zip((pairs // len(test.windows)).tolist(), (pairs % len(test.windows)).tolist(), strict=True):
            items[d].update(test.item[test.by_window[test.window_at[w] : test.window_at[w + 1]]].tolist())
        # longest matches: runs of windows along one item
        many = test.window_at[found + 1] - test.window_at[found]
        p, o = np.repeat(hit, many), np.repeat(owner, many)
        within = np.arange(len(p)) - np.repeat(np.cumsum(many) - many, many)
        w = test.by_window[np.repeat(test.window_at[found], many) + within]
        t, size = test.begin[w], test.length[w]
        by = np.lexsort((p, p - t, size))
        p, t, o, size, w = p[by], t[by], o[by], size[by], w[by]
        if len(p):
            new = np.ones(len(p), bool)
            new[1:] = (np.diff(p) != 1) | (np.diff(t) != 1) | (size[1:] != size[:-1])
            head = np.flatnonzero(new)
            length = np.diff(np.append(head, len(p))) + size[head] - 1
            best = np.lexsort((t[head], p[head], -length, o[head]))
            keep = best[np.unique(o[head][best], return_index=True)[1]]
            for k in keep.tolist():
                h = head[k]
                d, item = int(o[h]), int(test.item[w[h]])
                longest[d] = (int(length[k]), int(p[h] - origin[d]), item, int(t[h]) - test.base[item])
    for d in range(len(count)):
        own = {test.ids[k] for i in items[d] for k in test.owners[i]}
        size, where, item, source = longest[d]
        name = None if item is None else min((test.ids[k] for k in test.owners[item]), key=lambda x: (x is None, str(x)))
        yield int(count[d]), spans[d], own, (size, where, name, source)


def _merge(spans: list) -> list:
    out: list = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])
_FOUND = "n_words long, spans array<struct<start:int,end:int>>, items array<string>, longest long, longest_at long, longest_item string, longest_from long"
_KINDS = [pa.int64(), pa.list_(_SPAN), pa.list_(pa.string()), pa.int64(), pa.int64(), pa.string(), pa.int64()]


def _scan(batches, shared, n: int, at: int, later: bool):
    """Append the findings of one block of items to each row, or add them to those of earlier blocks."""
    test = ItemWindows(*shared.value, n)
    for batch in batches:
        width = batch.num_columns - (len(_KINDS) if later else 0)
        for i, j, raw, offsets in words.pieces(batch.column(at), 1 << 20):
            before = [batch.column(width + k).slice(i, j - i).to_pylist() for k in range(len(_KINDS))] if later else None
            out: list[list] = [[] for _ in _KINDS]
            for r, (count, spans, items, best) in enumerate(_shard(test, raw, offsets)):
                names = {"" if x is None else str(x) for x in items}
                if before:
                    spans = _merge(spans + [(s["start"], s["end"]) for s in before[1][r]])
                    names |= set(before[2][r])
                    best = max(best, tuple(x[r] for x in before[3:]), key=lambda x: x[0])
                best = (best[0], best[1], None if best[2] is None else str(best[2]), best[3])
                for x, y in zip(out, (count, spans, sorted(names), *best), strict=True):
                    x.append(y)
            cells = [[{"start": a, "end": b} for a, b in row] for row in out[1]]
            arrays = [pa.array(cells if k == 1 else out[k], kind) for k, kind in enumerate(_KINDS)]
            kept = [batch.column(k).slice(i, j - i) for k in range(width)]
            yield pa.RecordBatch.from_arrays([*kept, *arrays], names=[f"f{k}" for k in range(width + len(_KINDS))])


def matches(docs: DataFrame, items: DataFrame, keep: list[str], text_col: str = "text", item_col: str = "item_id", item_text: str = "text", n: int = 10, block_bytes: int = 8 << 20) -> DataFrame:
    """The columns ``keep`` of every row and what of ``items`` its whole text holds.

    Adds ``n_words, spans`` (hit words, end exclusive), ``items`` (ids as strings, sorted),
    ``longest`` (words of the longest verbatim match), ``longest_at`` (its place in the
    document), ``longest_item`` and ``longest_from``.  Words are runs of ASCII letters and
    digits or anything beyond ASCII, lower-cased (A-Z); a window is ``n`` consecutive words
    of an item, or all words of a shorter one.  Null and blank texts have no words; items
    without words are never found; an item without id counts under the id ``""``.  Repeated
    rows and ids stay; names in ``keep`` may repeat those added, as they come first.  Items
    beyond ``block_bytes`` of text are searched block after block in the same pass.
    """
    spark = docs.sparkSession
    small_batches(spark)
    size = items.agg(F.coalesce(F.sum(F.octet_length(F.col(item_text).cast("string"))), F.lit(0))).first()[0]
    blocks = max(1, ceil(size / block_bytes))
    listed = items.select(F.col(item_col).alias("item"), F.col(item_text).cast("string").alias("words"))
    wide = docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col(text_col).cast("string").alias("text"))
    kinds = [f.dataType.simpleString() for f in wide.schema.fields]
    schema = ", ".join(f"f{i} {kind}" for i, kind in enumerate(kinds)) + ", " + _FOUND
    out = wide
    for b in range(blocks):
        part = listed.where(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == b) if blocks > 1 else listed
        rows = part.collect()  # one block of the test items, about block_bytes
        shared = spark.sparkContext.broadcast(([r[0] for r in rows], [r[1] for r in rows]))
        out = out.mapInArrow(lambda it, s=shared, later=b > 0: freed(_scan(it, s, n, len(keep), later)), schema)
    found = [F.col(f.split()[0]) for f in ("n_words", "spans", "items", "longest", "longest_at", "longest_item", "longest_from")]
    return out.select(*(F.col(f"f{i}").alias(c) for i, c in enumerate(keep)), *found)


def _suffixes(batches, shared, n: int):
    """The longest match of every item suffix in the shards of a task."""
    test = ItemWindows(*shared.value, n, tails=True)
    size = np.zeros(len(test.begin), np.int64)
    doc, place = [None] * len(size), np.zeros(len(size), np.int64)
    for batch in batches:
        for i, _, raw, offsets in words.pieces(batch.column(1), 2 << 20):
            length, owner, at = _longest(test, raw, offsets)
            ids = batch.column(0)
            for k in np.flatnonzero(length > size).tolist():
                size[k], place[k], doc[k] = length[k], at[k], ids[i + int(owner[k])].as_py()
    found = np.flatnonzero(size).tolist()
    rows = [(k, o) for k in found for o in test.owners[test.item[k]]]
    item = [None if test.ids[o] is None else str(test.ids[o]) for _, o in rows]
    begin = [int(test.begin[k]) - test.base[test.item[k]] for k, _ in rows]
    yield pa.RecordBatch.from_arrays(
        [pa.array(item, pa.string()), pa.array(begin, pa.int64()), pa.array([int(size[k]) for k, _ in rows], pa.int64()), pa.array([doc[k] for k, _ in rows], pa.int64()), pa.array([int(place[k]) for k, _ in rows], pa.int64())],
        names=["item", "item_from", "length", "doc", "doc_at"],
    )


def suffix_matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", n: int = 10, block_bytes: int = 8 << 20) -> DataFrame:
    """The longest verbatim match of every suffix of every item: ``item, item_from, length, doc, doc_at``.

    A suffix begins at any word of an item and may match any number of words, also fewer
    than ``n``, to which depth the suffix arrays are sorted; those without a word in common
    have no row.  ``doc`` (a long) is the smallest id among equal lengths of different
    tasks, ``doc_at`` the word where it begins.  Null texts hold nothing; an empty table
    gives no rows.  Each block of items takes a pass of its own, and only the matches stay.
    """
    spark = docs.sparkSession
    small_batches(spark)
    size = items.agg(F.coalesce(F.sum(F.octet_length(F.col(item_text).cast("string"))), F.lit(0))).first()[0]
    blocks = max(1, ceil(size / block_bytes))
    listed = items.select(F.col(item_col).alias("item"), F.col(item_text).cast("string").alias("words"))
    wide = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema, out = "item string, item_from long, length long, doc long, doc_at long", None
    for b in range(blocks):
        rows = (listed.where(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == b) if blocks > 1 else listed).collect()  # one block, about block_bytes
        shared = spark.sparkContext.broadcast(([r[0] for r in rows], [r[1] for r in rows]))
        found = wide.mapInArrow(lambda it, s=shared: freed(_suffixes(it, s, n)), schema)
        best = found.groupBy("item", "item_from").agg(F.max_by(F.struct("length", "doc", "doc_at"), F.struct("length", -F.col("doc"))).alias("m"))
        out = best if out is None else out.unionByName(best)
    return out.select("item", "item_from", "m.*")


def report(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """Per row: id, ``n_words, n_hit, n_items, items_sha256, contaminated`` and the longest match."""
    got = matches(docs, items, [id_col], **options)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + (s["end"] - s["start"]))
    return got.select(
        F.col(id_col),
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
        F.col("longest").alias("longest_match"),
        F.col("longest_at").alias("longest_match_at"),
        F.col("longest_item").alias("longest_match_item"),
    )


def remove(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no window of any item.

    Null and blank texts hold none and stay, so do all rows if no item has words.  Whole
    texts are searched, of any length.  Repeated rows go or stay together; other columns
    of any name are kept; an empty table gives an empty one.
    """
    marked = docs.select(F.struct(*docs.columns).alias("row"), F.col(options.get("text_col", "text")).alias("text"))
    got = matches(marked, items, ["row"], **(options | {"text_col": "text"}))
    return got.where(F.size("spans") == 0).select("row.*")


def items_digest(ids: list[str]) -> str:
    """What ``items_sha256`` holds for these ids."""
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()

"""Best-fit packing of tokenised documents by a grouping genetic algorithm on islands.

Documents are tokenised where they lie and leave only their pieces' lengths and checksums.
Open pieces (shorter than a sequence) are dealt to shards of bounded size by a hash, and a
shard's packing problem is its histogram of lengths.  Several islands per shard evolve
whole packings: a child takes well-filled bins of one parent whole, drops the other
parent's bins that hold the same pieces, and best-fits what those held besides.  After each
epoch every island sends its best packing on to the next island, through a shuffle.  Pieces
then meet the slots of the best packing by (shard, length, rank).
"""

from __future__ import annotations

import os
import random
import zlib
from collections import Counter
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import freed, materialize, small_batches, trim
from .words import buffers, hashes
from .words import pieces as text_pieces

#: The vocabulary's own splitting rule is
#: ``'s|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?[^\\sLN]+|\\s+(?!\\S)|\\s+``, L letters, N numbers.  These are the
#: classes of texts up to U+024F and general punctuation, which do not differ between Unicode versions.
_SPACE, _LETTER, _NUMBER, _SIGN = 0, 1, 2, 3
_CLASS = np.full(256, _SIGN, np.uint8)  # of ASCII bytes
_CLASS[[*range(9, 14), 32]] = _SPACE
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASS[48:58] = _NUMBER
_LATIN = np.full((2, 256), _SIGN, np.uint8)  # of what follows the bytes C2 and C3
_LATIN[0, [0x85, 0xA0]] = _SPACE
_LATIN[0, [0xAA, 0xB5, 0xBA]] = _LETTER
_LATIN[0, [0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = _NUMBER
_LATIN[1, 0x80:0xC0] = _LETTER
_LATIN[1, [0x97, 0xB7]] = _SIGN
_SPECIAL = b"<|endoftext|>"
#: The vocabulary shows a byte as the character of its number, or from U+0100 on, in order, if that is no visible one.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SHOWN = dict(zip([*_PLAIN, *(b for b in range(256) if b not in _PLAIN)], [*_PLAIN, *range(256, 512)], strict=False))
_ONE, _TWO = frozenset(b"stmd"), frozenset((b"re", b"ve", b"ll"))


def _odd(raw: np.ndarray, at: np.ndarray) -> set[int]:
    """Texts with characters beyond those classes, or with a special token: the tokenizer reads these whole."""
    beyond = raw >= 0xCA
    wide = np.flatnonzero(raw == 0xE2)  # U+2010-2027, U+2030-205E and the euro sign
    if len(wide):
        x, y = raw[wide + 1], raw[wide + 2]
        beyond[wide[((x == 0x80) & (((y >= 0x90) & (y <= 0xA7)) | (y >= 0xB0))) | ((x == 0x81) & (y <= 0x9E)) | ((x == 0x82) & (y == 0xAC))]] = False
    out = set((np.searchsorted(at, np.flatnonzero(beyond), side="right") - 1).tolist())
    data, k = raw.tobytes(), -1
    while (k := data.find(_SPECIAL, k + 1)) >= 0:
        out.add(int(np.searchsorted(at, k, side="right")) - 1)
    return out


def _word_starts(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where the splitting rule starts a word, in the UTF-8 bytes of texts that begin at ``at``."""
    kind = _CLASS[raw]
    for low in (0xC2, 0xC3):
        p = np.flatnonzero(raw == low)
        kind[p] = kind[p + 1] = _LATIN[low - 0xC2, raw[p + 1]]
    p = np.flatnonzero((raw >= 0xC4) & (raw <= 0xC9))
    kind[p] = kind[p + 1] = _LETTER
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True  # texts part, so no run reaches over their ends
    edge[1:-1] |= kind[1:] != kind[:-1]
    starts = edge.copy()
    run = np.flatnonzero(edge)
    begin, end = run[:-1], run[1:]
    inner = np.ones(len(raw) + 1, bool)
    inner[at] = False
    # white space before something else: its last character stands alone, or leads the next word if it is a blank
    led = (kind[begin] == _SPACE) & inner[end]
    last = end[led] - 1
    last = last - ((raw[last] & 0xC0) == 0x80)
    starts[last] = True
    starts[end[led][raw[last] == 32]] = False
    # an apostrophe alone takes s, t, m, d, re, ve or ll
    for q in begin[(raw[begin] == 39) & (end == begin + 1) & inner[end]].tolist():
        if not starts[q] or kind[q + 1] != _LETTER:
            continue
        k = q + 2 if raw[q + 1] in _ONE else q + 3 if raw[q + 1 : q + 3].tobytes() in _TWO else 0
        if k and not edge[q + 2 : k].any():
            starts[q + 1], starts[k] = False, True
    return np.flatnonzero(starts[:-1])


class Encoder:
    """Token ids of many texts; words met before are found by a 64-bit hash in sorted arrays.

    At ``most`` words those go that were not met since the last time; about 40 bytes a word.
    """

    def __init__(self, vocabulary: str, most: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives each task its core
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_str(vocabulary), most
        self.key, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.pool, self.met = np.zeros(0, np.uint32), np.zeros(0, bool)

    def _learn(self, key: np.ndarray, data: bytes, begin: np.ndarray, end: np.ndarray) -> None:
        """Add distinct new words, given by rising keys and their places in ``data``."""
        tokenize = self.tokenizer.model.tokenize
        shown = b"".join(data[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)).decode("latin-1").translate(_SHOWN)
        last = np.cumsum(end - begin)
        ids = [[t.id for t in tokenize(shown[a:b])] for a, b in zip((last - (end - begin)).tolist(), last.tolist(), strict=True)]
        size = np.array([len(x) for x in ids], np.int32)
        place = np.searchsorted(self.key, key)
        at = len(self.pool) + np.cumsum(size) - size
        self.pool = np.concatenate([self.pool, np.array([x for w in ids for x in w], np.uint32)])
        self.key, self.at, self.size = (np.insert(x, place, y) for x, y in ((self.key, key), (self.at, at), (self.size, size)))
        self.met = np.insert(self.met, place, True)

    def _evict(self) -> None:
        keep = self.met if self.met.sum() <= self.most // 2 else np.zeros(len(self.met), bool)
        self.key, self.at, self.size = self.key[keep], self.at[keep], self.size[keep]
        used = _ragged(self.at, self.size)
        self.pool, self.at = self.pool[used], np.cumsum(self.size.astype(np.int64)) - self.size
        self.met = np.zeros(len(self.key), bool)

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian bytes."""
        raw, at = buffers(pa.array(texts, pa.string()))
        ids, size = self.ids(raw, at - at[0])
        data, last = ids.astype("<u4").tobytes(), np.cumsum(size) * 4
        return [data[a:b] for a, b in zip((last - size * 4).tolist(), last.tolist(), strict=True)]

    def ids(self, raw: np.ndarray, at: np.ndarray, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, each with ``end`` behind it if there is one, and how many each has."""
        closed = [] if end is None else [end]
        odd = _odd(raw, at)
        start = _word_starts(raw, at) if len(raw) else np.zeros(0, np.int64)
        h = hashes(raw, start, np.append(start[1:], len(raw))) if len(start) else np.zeros(0, np.uint64)
        if odd:
            inside = np.isin(np.searchsorted(at, start, side="right") - 1, list(odd))
            start, h, ends = start[~inside], h[~inside], np.append(start[1:], len(raw))[~inside]
        else:
            ends = np.append(start[1:], len(raw))
        want, first, which = np.unique(h, return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(self.key, want), max(len(self.key) - 1, 0))
        new = self.key[place] != want if len(self.key) else np.ones(len(want), bool)
        if new.any():
            if len(self.key) + int(new.sum()) > self.most:
                self._evict()
                place = np.minimum(np.searchsorted(self.key, want), max(len(self.key) - 1, 0))
                new = self.key[place] != want if len(self.key) else np.ones(len(want), bool)
            at_new = first[new]
            self._learn(want[new], raw.tobytes(), start[at_new], ends[at_new])
            place = np.searchsorted(self.key, want)
        self.met[place] = True
        # ids of the words in their order, then the odd texts' own, an end after each text
        word_at, word_size = self.at[place][which], self.size[place][which].astype(np.int64)
        tails = np.searchsorted(start, at[1:])
        pool, extra, length = [self.pool, np.array(closed, np.uint32)], len(self.pool), np.full(len(at) - 1, len(closed))
        tail_at = np.full(len(at) - 1, extra)
        extra += len(closed)
        for k in sorted(odd):
            text = raw[at[k] : at[k + 1]].tobytes().decode()
            ids = np.array([*self.tokenizer.encode(text, add_special_tokens=False).ids, *closed], np.uint32)
            pool.append(ids)
            tail_at[k], length[k], extra = extra, len(ids), extra + len(ids)
        all_at, all_size = np.insert(word_at, tails, tail_at), np.insert(word_size, tails, length)
        closing = tails + np.arange(len(tails))
        total = np.cumsum(all_size)[closing]
        return np.concatenate(pool)[_ragged(all_at, all_size)], np.diff(total, prepend=0)


def _ragged(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of stretches of ``size`` that begin at ``at``, one after the other."""
    size = size.astype(np.int64)
    return np.arange(int(size.sum())) + np.repeat(at - np.cumsum(size) + size, size)


def _pieces(batches, vocabulary, end: int, most: int):
    encode = Encoder(vocabulary.value)
    row = TaskContext.get().partitionId() << 33
    for batch in batches:
        for i, j, raw, at in text_pieces(batch.column(1), 1 << 19):
            ids, size = encode.ids(raw, at, end)
            count = -(-size // most)
            owner = np.repeat(np.arange(j - i), count)
            number = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            lead = size - (count - 1) * most  # the first piece takes what is over
            start = np.where(number == 0, 0, lead[owner] + (number - 1) * most)
            length = np.where(number == 0, lead[owner], most)
            data = memoryview(ids.astype("<u4").tobytes())
            low = (np.repeat(np.cumsum(size) - size, count) + start) * 4
            crc = [zlib.crc32(data[a:b]) for a, b in zip(low.tolist(), (low + length * 4).tolist(), strict=True)]
            columns = [np.arange(row, row + len(owner)), number, start, length, np.array(crc, np.int64)]
            row += len(owner)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i).take(pa.array(owner, pa.int32())), *(pa.array(c, pa.int64()) for c in columns)],
                names=["id", "row", "piece", "start", "length", "crc"],
            )


def best_fit(bins: list[tuple], items: list[int], most: int) -> list[tuple]:
    """Put items, longest first, each into the fullest bin that takes it; else open a bin."""
    items = sorted(items, reverse=True)
    if not items:
        return bins
    bins, rooms, mask = list(bins), {}, 0
    for k, b in enumerate(bins):
        if room := most - sum(b):
            rooms.setdefault(room, []).append(k)
            mask |= 1 << room
    for x in items:
        fits = mask >> x
        if fits:
            room = x + (fits & -fits).bit_length() - 1
            k = rooms[room].pop()
            if not rooms[room]:
                mask ^= 1 << room
            bins[k] += (x,)
        else:
            room, k = most, len(bins)
            bins.append((x,))
        if room := room - x:
            rooms.setdefault(room, []).append(k)
            mask |= 1 << room
    return bins


def fitness(bins: list[tuple], most: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones."""
    return -len(bins), sum((sum(b) / most) ** 2 for b in bins)


def crossover(a: list[tuple], b: list[tuple], most: int, rng: random.Random) -> list[tuple]:
    """Inject well-filled bins of ``b`` whole into ``a``; displaced pieces are best-fitted."""
    filled = sorted(b, key=lambda x: most - sum(x))[: max(1, len(b) * 9 // 10)]
    k = max(1, int(len(filled) * rng.uniform(0.02, 0.15)))
    at = rng.randrange(len(filled))
    taken = (filled + filled)[at : at + min(k, len(filled))]
    need = Counter(x for y in taken for x in y)
    kept, displaced = [], []
    for y in sorted(a, key=sum):  # the emptiest bins give way first
        if any(need.get(x) for x in y):
            for x in y:
                if need.get(x):
                    need[x] -= 1
                else:
                    displaced.append(x)
        else:
            kept.append(y)
    loose = max(1, len(kept) // 200)  # the emptiest bins are dissolved as well
    for y in kept[:loose]:
        displaced.extend(y)
    return best_fit(kept[loose:] + taken, displaced, most)


def evolve(items: list[int], population: list[list[tuple]], most: int, rng: random.Random, size: int, generations: int) -> list[list[tuple]]:
    """Evolve packings of ``items``, the best first; it ends early at the fewest bins possible."""
    least = max(ceil(sum(items) / most), sum(2 * x > most for x in items))
    population = population or [best_fit([], items, most)]
    rank = lambda p: fitness(p, most)
    while len(population) < size and -rank(population[0])[0] > least:
        some = rng.sample(items, len(items) // 20)  # some pieces settle early, the others as best fits
        rest = list((Counter(items) - Counter(some)).elements())
        population.append(best_fit(best_fit([], some, most), rest, most))
    population.sort(key=rank, reverse=True)
    for _ in range(generations):
        if len(population[0]) <= least or len(population) < 2:
            break
        a, b = rng.sample(population, 2)
        child = crossover(a, b, most, rng)
        if rank(child) > rank(population[-1]):
            population[-1] = child
            population.sort(key=rank, reverse=True)
    return population[:size]


def _pack(bins: list[tuple]) -> bytes:
    return np.array([x for b in bins for x in (*b, 0)], np.int32).tobytes()


def _unpack(data: bytes) -> list[tuple]:
    out, now = [], []
    for x in np.frombuffer(data, np.int32).tolist():
        if x:
            now.append(x)
        else:
            out.append(tuple(now))
            now = []
    return out


_STATE = "shard long, island int, epoch int, lengths array<int>, times array<long>, packings array<binary>"


def _epoch(key, frame: pd.DataFrame, most: int, islands: int, size: int, generations: int) -> pd.DataFrame:
    """One island's epoch: its packings and those that came in; out go they, and the best to the next island."""
    first = frame.iloc[0]
    items = [int(x) for x, n in zip(first["lengths"], first["times"], strict=True) for _ in range(n)]
    population = [_unpack(p) for row in frame["packings"] if row is not None for p in row]
    epoch = int(frame["epoch"].max())
    rng = random.Random(f"{key[0]}.{key[1]}.{epoch}")
    population = [_pack(p) for p in evolve(items, population, most, rng, size, generations)]
    own = (key[0], key[1], epoch + 1, first["lengths"], first["times"])
    sent = (key[0], (key[1] + 1) % islands, epoch + 1, first["lengths"], first["times"])
    rows = [(*own, population)] + [(*sent, population[:1])] * (islands > 1)
    trim()
    return pd.DataFrame(rows, columns=["shard", "island", "epoch", "lengths", "times", "packings"])


def _slots(key, frame: pd.DataFrame, most: int) -> pd.DataFrame:
    """The places that the best packing of a shard has for its pieces, by length and number."""
    best = max((_unpack(row[0]) for row in frame["packings"]), key=lambda p: fitness(p, most))
    count: Counter = Counter()
    out = []
    for k, b in enumerate(best):
        at = 0
        for x in b:
            count[x] += 1
            out.append((key[0], x, count[x], k, at))
            at += x
    return pd.DataFrame(out, columns=["shard", "length", "slot", "bin", "offset"], dtype="int64")


def pack(
    docs: DataFrame,
    vocabulary: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    most: int = 1024,
    end: int = 2,
    shard_items: int = 30_000,
    islands: int = 3,
    epochs: int = 2,
    size: int = 4,
    generations: int = 10,
) -> DataFrame:
    """One row per piece: ``id_col, piece, start, length, ids_crc32, sequence_id, offset``.

    ``vocabulary`` names a tokenizer file, read on the driver.  A document is its ids and
    then ``end``; one longer than ``most`` is cut, the first piece taking what is over.
    Null texts are empty (the end alone).  Repeated rows and ids, null ids and ties are
    packed as they come, other columns are ignored, an empty table gives an empty one.
    ``shard_items`` bounds a shard's share of open pieces on average; the number of shards
    follows the data.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with open(vocabulary, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    pieces = rows.mapInArrow(lambda it: freed(_pieces(it, shared, end, most)), f"id {kind}, row long, piece long, start long, length long, crc long")
    pieces = materialize(pieces, "pieces")
    open_ = pieces.where(F.col("length") < most)
    shards = max(1, ceil(open_.count() / shard_items))
    open_ = open_.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)))
    counted = open_.groupBy("shard", F.col("length").cast("int").alias("length")).agg(F.count("*").alias("n"))
    state = counted.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("length", "n"))).alias("h"))  # under `most` entries
    state = state.select(
        "shard",
        F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"),
        F.lit(0).alias("epoch"),
        F.col("h.length").alias("lengths"),
        F.col("h.n").alias("times"),
        F.lit(None).cast("array<binary>").alias("packings"),
    )
    for _ in range(epochs):
        state = state.repartition(shards * islands, "shard", "island")
        state = state.groupBy("shard", "island").applyInPandas(lambda k, f: _epoch(k, f, most, islands, size, generations), _STATE)
    slots = state.groupBy("shard").applyInPandas(lambda k, f: _slots(k, f, most), "shard long, length long, slot long, bin long, offset long")
    rank = F.row_number().over(Window.partitionBy("shard", "length").orderBy("row")).cast("long").alias("slot")
    placed = open_.select("*", rank).join(slots, ["shard", "length", "slot"])
    out = placed.select("id", "piece", "start", "length", "crc", (F.col("bin") * shards + F.col("shard")).alias("sequence_id"), "offset")
    whole = pieces.where(F.col("length") == most)
    whole = whole.select("id", "piece", "start", "length", "crc", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return out.unionByName(whole).withColumnsRenamed({"id": id_col, "crc": "ids_crc32"})

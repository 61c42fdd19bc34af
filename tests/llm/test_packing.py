import random
import zlib
from collections import Counter, defaultdict
from math import ceil

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from ledgerloom.llm.packing import Encoder, best_fit, crossover, evolve, fitness, pack

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, piece string, bin int"


def texts():
    rng = random.Random(4)
    vocab = ["The", "don't", "we'll", "it's", "'sabc", "été", "Straße", "x²", "½", "漢字", "  ", "\n\n", "\t", "a b", "...", "?'s", "--", "12345", "​", "😀", "ʼn", "_", "\x85"]
    made = [rng.choice([" ", "", "\n", "  "]).join(rng.choice(vocab) for _ in range(rng.randint(1, 200))) for _ in range(120)]
    return [None, "", " ", "   \n ", "<|endoftext|> hi", "a" * 5000, "word " * 7000, *made]


def test_ids_are_the_tokenizers():
    whole = Tokenizer.from_file(PATH)
    said = [t or "" for t in texts()]
    encode = Encoder(open(PATH, encoding="utf-8").read(), most=300)
    want = [np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in said]
    assert encode(said) == want and encode(said[:9]) == want[:9]


def check(rows, got, most):
    whole = Tokenizer.from_file(PATH)
    want = Counter()
    for i, t, *_ in rows:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 2]
        start, k = 0, 0
        while start < len(ids):
            size = (len(ids) % most or most) if k == 0 else most
            want[i, k, start, size, zlib.crc32(np.array(ids[start : start + size], "<u4").tobytes())] += 1
            start, k = start + size, k + 1
    assert Counter(tuple(r)[:5] for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= most
    return len(bins), sum(r.length for r in got)


def test_pack(spark):
    rows = [(k, t, "x", 0) for k, t in enumerate(texts())] + [(None, "no id", "", 0), (5, "a" * 5000, "", 0), (5, "a" * 5000, "", 0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for shard_items in (30_000, 40):
        got = pack(df, PATH, shard_items=shard_items)
        assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
        used, total = check(rows, got.collect(), 1024)
        assert used <= ceil(total / 1024) + 8
    assert pack(df.where("false"), PATH).collect() == []


def test_children_hold_the_same_pieces():
    rng = random.Random(1)
    items = [min(1023, max(1, int(rng.gauss(400, 250)))) for _ in range(800)]
    a = best_fit([], items, 1024)
    b = best_fit(best_fit([], items[:300], 1024), items[300:], 1024)
    for _ in range(30):
        child = crossover(a, b, 1024, rng)
        assert Counter(x for y in child for x in y) == Counter(items) and max(map(sum, child)) <= 1024
        a, b = max(a, child, key=lambda p: fitness(p, 1024)), a
    first = fitness(best_fit([], items, 1024), 1024)
    best = evolve(items, [], 1024, random.Random(2), 4, 30)
    assert fitness(best[0], 1024) >= first and len(best) <= 4
    assert evolve([], [], 1024, rng, 4, 3) == [[]]


def test_the_population_beats_best_fit():
    # each sequence holds three pieces that sum to its size, which longest-first best fit tears apart
    rng = random.Random(20)
    items = []
    for _ in range(20):
        a = rng.randint(180, 430)
        b = rng.randint(180, 1024 - a - 180)
        items += [a, b, 1024 - a - b]
    plain = best_fit([], items, 1024)
    best = evolve(items, [], 1024, random.Random(3), 8, 300)[0]
    assert Counter(x for y in best for x in y) == Counter(items) and max(map(sum, best)) <= 1024
    assert len(best) < len(plain)


def test_recurring_words_survive_evictions():
    encode = Encoder(open(PATH, encoding="utf-8").read(), most=40)
    whole = Tokenizer.from_file(PATH)
    for k in range(6):
        said = [f"common words {k} word{k * 7 + j} stay" for j in range(9)]
        assert encode(said) == [np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in said]

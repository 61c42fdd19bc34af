import itertools
import random
import re

import numpy as np

from ledgerloom.llm.ngram_join import jaccard_components, keep_one, overlaps

SCHEMA = "doc_id long, text string, node string, key int"


def brute(rows, n=5, percent=80):
    def items(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())

    sets = [items(r[1]) for r in rows]
    part = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            old, new = part[b], part[a]
            part = [new if p == old else p for p in part]
    low = {}
    for r, p in zip(rows, part, strict=True):
        low[p] = min(low.get(p, r[0]), r[0])
    return sorted((r[0], len(s), low[p]) for r, s, p in zip(rows, sets, part, strict=True))


def made():
    rng = random.Random(5)
    vocab = ["w%d" % i for i in range(300)] + ["É", "ß", "漢字", "A.b"]
    texts = [None, "", " \t\n", "one", "One", "a b c", "A b\tc", "a b c d", "x\x00y z"]
    for _ in range(12):
        base = [rng.choice(vocab) for _ in range(rng.randint(8, 120))]
        for _ in range(rng.randint(1, 14)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            texts.append((" " if rng.random() < 0.5 else "\n").join(copy))
    texts.append(" ".join(rng.choice(vocab) for _ in range(20000)))
    rows = [(i, t, "x", i) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


def test_equals_brute_force(spark):
    rows = made()
    want = brute(rows)
    for block in (512, 3):
        got = jaccard_components(spark.createDataFrame(rows, SCHEMA).repartition(3), block=block, broadcast_rows=10 if block == 3 else 1000)
        assert got.columns == ["doc_id", "n_shingles", "component_id"]
        assert sorted(map(tuple, got.collect())) == want


def test_edge_cases(spark):
    same = "q w e r t y u i o p"
    rows = [(7, same, "x", 1), (7, same, "x", 1), (3, same, None, None), (7, "other text of one two three", "x", 2), (None, "null id", "x", 3)]
    got = sorted(map(tuple, jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == sorted([(7, 6, 3), (7, 6, 3), (3, 6, 3), (7, 2, 7), (None, 1, None)], key=str)
    assert jaccard_components(spark.createDataFrame([], SCHEMA)).collect() == []


def test_product_counts_overlaps():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 40, 30)).astype(np.uint64) for _ in range(9)]
    for columns in (8192, 7):
        got = overlaps(sets[:4], sets[4:], columns)
        assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[4:]] for a in sets[:4]]


def test_candidates_lose_no_link(spark):
    """Groups of near copies, shared passages and every setting of the candidate search give the same classes."""
    rng = random.Random(8)
    vocab = ["w%d" % i for i in range(5000)]
    say = lambda k: [rng.choice(vocab) for _ in range(k)]
    passages = [say(40) for _ in range(5)]
    texts = []
    for _ in range(25):
        base = say(rng.randint(60, 150)) + rng.choice(passages) + say(20)
        for _ in range(rng.choice([1, 2, 30])):
            copy = list(base)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            texts.append(" ".join(copy))
    rows = [(i, t, "x", 0) for i, t in enumerate(texts)]
    want = brute(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    for options in ({}, {"few": 1}, {"few": 1000, "frequent": 1}, {"block": 7}):
        assert sorted(map(tuple, jaccard_components(df, **options).collect())) == want


def test_keep_one(spark):
    rows = [*made(), (0, "a b c d e f", "y", 1), (0, "a b c d e f", "y", 1), (1, "A b c d e f", "z", 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = keep_one(df)
    assert got.columns == df.columns
    want = brute(rows)
    kept = [tuple(r) for r in got.collect()]
    assert len(kept) == sum(size == 0 for _, size, _ in want) + len({c for _, size, c in want if size})
    assert sum(r[1] in ("a b c d e f", "A b c d e f") for r in kept) == 1
    assert keep_one(df, broadcast_rows=0).count() == len(kept)

import random
import re
import zlib
from collections import Counter
from functools import lru_cache
from math import exp, isclose, log, log10

import numpy as np
import public_tokenizers
import pyarrow as pa

from ledgerloom.llm.lattice_lm import Lattice, by_length, lattice_scores, load_pieces

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, score double, held_out string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def base(rows):
    train = Counter(w for i, t in rows if not held(i) for w in words(t))
    ends = sum(not held(i) for i, _ in rows)
    total, distinct = sum(train.values()) + ends, len(train) + (ends > 0)
    p = lambda c: log10((c + 0.5) / (total + 0.5 * (distinct + 1)))
    return [
        (i, held(i), len(words(t)) + 1, sum(train[w] > 0 for w in words(t)) + (ends > 0), total, sum(p(train[w]) for w in words(t)) + p(ends))
        for i, t in rows
    ]


def test_forward_sums_all_segmentations():
    pieces = [bytes([b]) for b in range(256)] + [b"ab", b"ba", b" a", b"aba", b" abab"]
    rng = np.random.default_rng(2)
    counts = rng.random(len(pieces) + 1)
    lattice = Lattice(pieces, counts, smooth=0)
    p = {w: c / counts.sum() for w, c in zip(pieces, counts, strict=False)}
    assert isclose(sum(p.values()) + exp(lattice.end), 1)

    @lru_cache(None)
    def brute(s):
        return 1.0 if not s else sum(p[s[:k]] * brute(s[k:]) for k in range(1, len(s) + 1) if s[:k] in p)

    said = [b"ababab", b"b", b"bbaba", b"zaba", b"aa"]
    got, expected = {}, np.zeros(len(pieces))
    for rows, grid in by_length(pa.array(said)):
        got |= dict(zip(rows.tolist(), lattice.forward(grid)[:, -1].tolist(), strict=True))
        lattice.expected(grid, np.ones(len(rows)), expected)
    assert all(isclose(got[k], log(brute(b" " + w)), abs_tol=1e-9) for k, w in enumerate(said))
    covered = sum(c * len(w) for c, w in zip(expected, pieces, strict=True))
    assert isclose(covered, sum(len(w) + 1 for w in said), rel_tol=1e-9)


def test_long_words_are_summed_in_blocks(monkeypatch):
    from ledgerloom.llm import lattice_lm

    lattice = Lattice(load_pieces(PATH), np.ones(50257))
    grid = np.frombuffer((" the-" * 40).encode(), np.uint8)[None, :]
    whole, counts = lattice.forward(grid), np.zeros(50256)
    lattice.expected(grid, np.ones(1), counts)
    monkeypatch.setattr(lattice_lm, "_STARTS", 7)
    again = np.zeros(50256)
    lattice.expected(grid, np.ones(1), again)
    assert np.allclose(lattice.forward(grid), whole) and np.allclose(counts, again)


def test_scores(spark):
    rng = random.Random(1)
    vocab = ["the", "of", "Tion", "été", "x" * 300] + ["w%d" % rng.randrange(500) for _ in range(80)]
    rows = [(i, rng.choice([" ", "\n"]).join(rng.choice(vocab) for _ in range(rng.randint(0, 60)))) for i in range(60)]
    rows += [(None, "the of"), (77, None), (78, ""), (5, "the the"), (5, "the the")]
    df = spark.createDataFrame([(*r, 0.0, "x") for r in rows], SCHEMA).repartition(3)
    for head in (200_000, 5, 0):
        got = sorted(map(tuple, lattice_scores(df, PATH, head=head).collect()), key=str)
        for a, b in zip(got, sorted(base(rows), key=str), strict=True):
            assert a[:5] == b[:5] and isclose(a[5], b[5], rel_tol=1e-9) and a[6] < 0
        if head == 200_000:
            first = got
        assert all(isclose(a[6], b[6], rel_tol=1e-9) for a, b in zip(first, got, strict=True))


def test_empty_table(spark):
    assert lattice_scores(spark.createDataFrame([], SCHEMA), PATH).collect() == []
    only = spark.createDataFrame([(1, "a b", 0.0, "")], SCHEMA) if held(1) else spark.createDataFrame([(6, "a b", 0.0, "")], SCHEMA)
    assert lattice_scores(only, PATH).count() == 1

import random
import zlib
from collections import Counter, defaultdict
from math import isclose, log2

from ledgerloom.llm.language_id import keep_identified, report

SCHEMA = "doc_id long, text string, lang string, score string"
SAY = {"en": "the and of to ing tion with that", "de": "der und ein ich für über nicht schon", "fr": "le être une où très déjà avec pour"}


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode()


def brute(rows):
    """Every text under byte-wise trees of dictionaries."""
    count = defaultdict(lambda: defaultdict(Counter))
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    for i, t, lang in rows:
        if not held(i) and lang is not None and t is not None:
            b = b"   " + low(t)
            for k in range(3, len(b)):
                for n in range(4):
                    count[lang][b[k - n : k]][b[k]] += 1

    def bits(t, lang):
        b, total = b"   " + low(t), 0.0
        for k in range(3, len(b)):
            for n in (3, 2, 1, 0):
                c = count[lang].get(b[k - n : k])
                if c:
                    if b[k] in c:
                        total += log2((sum(c.values()) + len(c)) / c[b[k]])
                        break
                    total += log2((sum(c.values()) + len(c)) / len(c))
            else:
                total += 8
        return total

    out = []
    for i, t, _ in rows:
        if t is None or not any(c.isalpha() for c in t) or not count:
            out.append((i, held(i), "und", 0.0))
        else:
            b = {x: bits(t, x) for x in sorted(count)}
            best = min(b, key=b.get)
            out.append((i, held(i), best, 1 / sum(2 ** (b[best] - v) for v in b.values())))
    return sorted(out, key=str)


def made():
    rng = random.Random(6)
    rows = [(None, None, "en"), (200, "", "en"), (201, "123 !?", "de"), (202, "Ж", None), (203, "漢字 the", "fr"), (204, "t", "en"), (204, "t", "en")]
    for i in range(150):
        lang = rng.choice(list(SAY))
        rows.append((i, " ".join(rng.choice(SAY[lang].split()) for _ in range(rng.randint(1, 30))).title(), lang))
    return rows


def test_equals_brute_force(spark):
    rows = made()
    df = spark.createDataFrame([(*r, "s") for r in rows], SCHEMA).repartition(3)
    got = sorted((tuple(r)[:4] for r in report(df).collect()), key=str)
    want = brute(rows)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(isclose(g[3], w[3], abs_tol=1e-3) for g, w in zip(got, want, strict=True))
    fair = [(lang, g) for i, _, lang in rows for g in got if g[0] == i and g[1] and g[2] != "und"]
    assert sum(a == g[2] for a, g in fair) >= 0.95 * len(fair)
    kept = keep_identified(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} >= {g[0] for g in got if g[2] != "und" and g[3] >= 0.6}


def test_edge_cases(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert report(none).collect() == []
    plain = spark.createDataFrame([(0, "text", None, ""), (1, None, "en", "")], SCHEMA)
    assert {(r.lang_pred, r.score) for r in report(plain).collect()} == {("und", 0.0)}

import random
import re

from ledgerloom.llm.decontaminate import items_digest, matches, remove, report, suffix_matches

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, n=10):
    out = []
    for i, text in docs:
        w, hit, ids = words(text), set(), set()
        for item, t in items:
            v = words(t)
            k = min(n, len(v))
            for s in range(len(v) - k + 1 if v else 0):
                for p in range(len(w) - k + 1):
                    if w[p : p + k] == v[s : s + k]:
                        hit.update(range(p, p + k))
                        ids.add(str(item))
        out.append((i, len(w), len(hit), len(ids), items_digest(list(ids)), bool(hit)))
    return sorted(out, key=str)


def made():
    rng = random.Random(3)
    vocab = ["the", "of", "Été", "x9", "zu", "漢"] + ["v%d" % i for i in range(40)]
    say = lambda k: [rng.choice(vocab) for _ in range(k)]
    items = [(k, rng.choice([" ", ", ", "\n"]).join(say(rng.choice([0, 1, 3, 9, 10, 11, 35])))) for k in range(20)]
    items += [(50, items[7][1]), (51, None), (9, items[3][1] + " tail"), (52, " ".join(words(items[6][1])[:12]) + " more words here")]
    docs = [(None, "the of"), (0, None), (1, ""), (2, "?!"), (3, "THE")]
    for k in range(60):
        w = say(rng.randint(0, 80))
        for _ in range(rng.randint(0, 3)):
            v = words(rng.choice(items)[1])
            a = rng.randint(0, max(0, len(v) - 10))
            at = rng.randint(0, len(w))
            w[at:at] = v[a : a + rng.randint(8, 40)]
        docs.append((10 + k, " ".join(w)))
    docs.append((99, " ".join(say(30000))))
    return docs, items


def test_equals_brute_force(spark):
    docs, items = made()
    d = spark.createDataFrame([(*r, "m", 1) for r in docs], "doc_id long, text string, items string, n_hit int").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    for size in (8 << 20, 300):
        got = [tuple(r)[:6] for r in report(d, b, block_bytes=size).collect()]
        assert sorted(got, key=str) == want
    clean = remove(d, b)
    assert clean.columns == d.columns
    assert sorted((r.doc_id for r in clean.collect()), key=str) == sorted((r[0] for r in want if not r[5]), key=str)


def test_longest_match(spark):
    a = [f"w{i}" for i in range(40)]
    docs = [(1, " ".join(["z", "z", *a[5:28], "q", *a[:12]])), (2, " ".join(a[:9]))]
    got = matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("i", " ".join(a)), ("short", "q w0")], "item_id string, text string"), ["doc_id"]).collect()
    one, two = sorted(got)
    assert (one.longest, one.longest_at, one.longest_item, one.longest_from) == (23, 2, "i", 5)
    assert [tuple(s) for s in one.spans] == [(2, 38)] and one["items"] == ["i", "short"]
    assert (two.longest, two.spans, two["items"]) == (0, [], [])


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert report(none, items).collect() == []
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c")], "doc_id long, text string")
    assert [r.n_hit for r in report(docs, items).collect()] == [3, 3]
    assert [r.contaminated for r in report(docs, items.where("false")).collect()] == [False, False]


def common(a, b):
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return k


def test_longest_match_of_every_suffix(spark):
    rng = random.Random(6)
    say = lambda k: " ".join(rng.choice("a b c d e é zz".split()) for _ in range(k))
    items = [(k, say(rng.randint(0, 25))) for k in range(8)] + [(9, None)]
    docs = [(k, say(rng.randint(0, 40))) for k in range(20)] + [(50, items[2][1] + " " + items[3][1]), (51, None)]
    text = {i: words(t) for i, t in docs}
    d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    for n, size in ((4, 8 << 20), (40, 60)):
        got = {(r["item"], r["item_from"]): r for r in suffix_matches(d, b, n=n, block_bytes=size).collect()}
        for i, t in items:
            w = words(t)
            for f in range(len(w)):
                want = max(common(w[f:], v[p:]) for v in text.values() for p in range(len(v) + 1))
                r = got.get((str(i), f))
                assert (r["length"] if r else 0) == want
                assert not r or common(w[f:], text[r["doc"]][r["doc_at"] :]) == want

import random

from ledgerloom.llm.line_dedup import dedup_lines, report

SCHEMA = "doc_id long, text string, key string, drop int"


def shingles(line, n=8):
    w = line.encode("utf-16-be")
    k = max(len(w) // 2 - n, 0)
    return {w[2 * i : 2 * (i + n)] for i in range(k + 1)}


def brute(rows, percent=80):
    """Texts that stay, with all pairs of lines compared."""
    seen = {}
    for i, t in rows:
        for k, line in enumerate((t or "").split("\n")):
            if norm := line.strip(" ").lower():
                seen.setdefault(norm, []).append((i, k))
    lines = list(seen)
    sets = [shingles(x) for x in lines]
    part = list(range(len(lines)))
    for a in range(len(lines)):
        for b in range(a):
            c = len(sets[a] & sets[b])
            if c * (100 + percent) >= percent * (len(sets[a]) + len(sets[b])):
                old, new = part[a], part[b]
                part = [new if p == old else p for p in part]
    stays = {}
    for x, p in zip(lines, part, strict=True):
        stays[p] = min([stays.get(p, (1 << 60, 0)), *seen[x]])
    of = dict(zip(lines, part, strict=True))
    out = []
    for i, t in rows:
        kept = [x for k, x in enumerate((t or "").split("\n")) if not (n := x.strip(" ").lower()) or stays[of[n]] == (i, k)]
        out.append((i, None if t is None else "\n".join(kept)))
    return sorted(out)


def test_equals_brute_force(spark):
    rng = random.Random(2)
    vocab = ["the", "quick", "Éclair", "漢字", "fox", "😀"] + ["word%d" % i for i in range(400)]
    base = [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 40))) for _ in range(60)]
    rows = [(0, None), (1, ""), (2, "\n\n"), (3, " x \nX\n")]
    for i in range(60):
        lines = []
        for _ in range(rng.randint(1, 8)):
            line = rng.choice(base)
            if rng.random() < 0.4 and len(line) > 150:
                at = rng.randrange(len(line))
                line = line[:at] + rng.choice("abc") + line[at + 1 :]
            lines.append(rng.choice(["", "  "]) + line)
        rows.append((10 + i, "\n".join(lines)))
    rows.append((99, " ".join(rng.choice(vocab) for _ in range(5000))))
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    want = brute(rows)
    for limit in (500_000, 3):
        got = dedup_lines(df, broadcast_rows=limit)
        assert got.columns == df.columns
        assert sorted((r.doc_id, r.text) for r in got.collect()) == want


def templated(rng, families, pairs):
    """Lines of templates, at about 0.6 to each other, each with one partner at 0.80 to 0.85."""
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    made = lambda k: "".join(rng.choice(letters) for _ in range(k))
    out = []
    for _ in range(families):
        head = made(187)
        for _ in range(pairs):
            line = head + made(60)
            at = 187 + rng.randrange(10, 28)
            other = line[:at] + made(16) + line[at + 16 :]
            like = len(shingles(line) & shingles(other)) / len(shingles(line) | shingles(other))
            assert 0.8 <= like <= 0.85
            out += [line, other]
    rng.shuffle(out)
    return out


def recall(spark, rng, families, pairs):
    lines = templated(rng, families, pairs)
    got = report(spark.createDataFrame([(i, x, "", 0) for i, x in enumerate(lines)], SCHEMA))
    return sum(r.n_dropped for r in got.collect()) / (families * pairs)


def test_recall_on_a_templated_family(spark):
    assert recall(spark, random.Random(5), 1, 150) >= 0.98


def test_edge_cases(spark):
    rows = [(5, "same line here\nother", "k", 1), (5, "same line here\nother", "k", 1), (None, "same line here", "", 2)]
    got = report(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r.doc_id), r.n_kept, r.n_dropped, r.text) for r in got) == [("5", 1, 1, "other"), ("5", 1, 1, "other"), ("None", 1, 0, "same line here")]
    assert report(spark.createDataFrame([], SCHEMA)).collect() == []

import numpy as np

from ledgerloom.llm.embedding_dedup import near_duplicates, needed

SCHEMA = "vec_id long, embedding array<float>, kept string, label int"


def brute(rows, least=0.95):
    good = [k for k, r in enumerate(rows) if r[1] and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])]
    n, part = [0] * len(rows), list(range(len(rows)))
    for x in good:
        for y in good:
            if x != y and len(rows[x][1]) == len(rows[y][1]):
                a, b = np.array(rows[x][1], np.float32).astype(float), np.array(rows[y][1], np.float32).astype(float)
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= least:
                    n[x] += 1
                    part = [part[x] if p == part[y] else p for p in part]
    low = {}
    for r, p in zip(rows, part, strict=True):
        low[p] = min(low.get(p, r[0]), r[0])
    return sorted((r[0], n[k], low[part[k]], r[0] == low[part[k]]) for k, r in enumerate(rows))


def test_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    made = []
    for size in (1, 1, 2, 3, 9, 150):
        base = rng.standard_normal(16)
        made += [(base + rng.standard_normal(16) * 0.12).tolist() for _ in range(size)]
    made += [rng.standard_normal(16).tolist() for _ in range(200)] + [made[5]] * 3
    made += [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0]]
    rows = [(int(i) + 5, v, "x", 0) for i, v in zip(rng.permutation(len(made)), made, strict=True)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = brute(rows)
    for options in ({}, {"block": 40, "window": 16}):
        got = near_duplicates(df, **options)
        assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
        assert sorted(map(tuple, got.collect())) == want


def test_edge_cases(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(4, [1.0, 1.0], "", 0), (4, [1.0, 1.0], "", 0), (None, [1.0, -1.0], "", 0)]
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(4, 1, 4, True), (4, 1, 4, True), (None, 0, None, None)]))


def test_passes_follow_the_number_of_vectors():
    assert needed(1000, 0.95, 48) == (24, 40)
    few, many = needed(10**6, 0.95, 48), needed(10**9, 0.95, 48)
    assert 24 <= few[0] < many[0] < 100 and few[1] == 40 and many[1] == 60


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(7)
    n, dim, pairs = 12_000, 64, 300
    base = rng.standard_normal((n, dim))
    base[:4000] = base[0] + 0.33 * base[:4000]  # a dense region, at cosine about 0.9
    unit = base / np.linalg.norm(base, axis=1, keepdims=True)
    noise = rng.standard_normal((pairs, dim))
    at = rng.choice(n, pairs, replace=False)
    noise -= (noise * unit[at]).sum(1, keepdims=True) * unit[at]
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    cosine = rng.uniform(0.951, 0.96, (pairs, 1))
    near = cosine * unit[at] + np.sqrt(1 - cosine**2) * noise
    rows = [(k, v.tolist(), "", 0) for k, v in enumerate(np.concatenate([unit, near]).astype(np.float32))]
    got = {r.vec_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sum(got[n + k] == got[int(a)] for k, a in enumerate(at)) >= 0.95 * pairs

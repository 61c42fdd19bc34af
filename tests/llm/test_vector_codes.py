import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from ledgerloom.llm.vector_codes import nearest, padded, report, sequency, sql, whole

SCHEMA = "vec_id long, embedding array<{}>, label int, code string, error long, id int"


def brute(rows, parts=16, entries=64, rounds=2, scale=256):
    """By the distances themselves, in Python integers."""
    rows = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    width = -(-max((len(r[1]) for r in rows), default=0) // parts) * parts
    size = width // parts
    floor = lambda x: (lambda n, d: scale * n // d)(*float(x).as_integer_ratio())
    cut = []
    for key, v, *_ in rows:
        v = [floor(x) for x in v] + [0] * (width - len(v))
        cut.append((key, [tuple(v[p * size : (p + 1) * size]) for p in range(parts)]))
    first = sorted(range(len(cut)), key=lambda i: (cut[i][0] is None, cut[i][0] or 0, list(rows[i][1])))[:entries]
    books = [[cut[i][1][p] for i in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda q, book: min((far(q, c), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            mine = {}
            for _, q in cut:
                mine.setdefault(best(q[p], books[p])[1], []).append(q[p])
            books[p] = [tuple(sum(x) // len(mine[e]) for x in zip(*mine[e], strict=True)) if e in mine else c for e, c in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    found, fit = [], lambda x: x if x is not None and x < 1 << 63 else None
    for (key, q), r in zip(cut, rows, strict=True):
        got = [best(q[p], books[p]) for p in range(parts)]
        found.append((key, "".join(f"{e:02x}" for _, e in got), fit(sum(d for d, _ in got)), r[2]))
    total = {}
    for _, _, e, label in found:
        total[label] = None if e is None or label in total and total[label] is None else total.get(label, 0) + e
    return sorted(((k, c, e, fit(total[label]), digest) for k, c, e, label in found), key=repr)


def told(spark, rows, kind="float", **options):
    df = spark.createDataFrame([(*r, "c", 1, 2) for r in rows], SCHEMA.format(kind)).repartition(3)
    return sorted(map(tuple, report(df, **options).collect()), key=repr)


def vectors(n, dims, seed=3, spread=1.0):
    dice = random.Random(seed)
    return [(k, [float(np.float32(dice.gauss(0, spread))) for _ in range(dims)], dice.choice([1, 2, 2, 2, None])) for k in range(n)]


@pytest.mark.parametrize("dims", [16, 48, 80])
@pytest.mark.parametrize("broadcast_rows", [100_000, 0])
def test_equals_brute_force(spark, dims, broadcast_rows):
    rows = vectors(150, dims)
    rows += [(200, None, 1), (201, [None] * dims, 1), (202, [math.nan] + [0.0] * (dims - 1), 2), (203, [math.inf] + [0.0] * (dims - 1), 2), (204, [0.0] * dims, None), (205, [-0.0] * dims, None)]
    rows += [rows[0]] * 3 + [(5, [1.0] * dims, 1), (None, [0.5] * dims, 1)]
    assert told(spark, rows, broadcast_rows=broadcast_rows) == brute(rows)


def test_equals_sql(spark):
    rows = vectors(300, 64, spread=0.1)
    con = duckdb.connect()
    con.execute("create table embeddings(vec_id bigint, embedding float[], label int)")
    con.executemany("insert into embeddings values (?, ?, ?)", rows)
    assert told(spark, rows) == sorted(con.execute(sql()).fetchall(), key=repr)


def test_numbers_beyond_64_bits_are_exact(spark):
    rows = vectors(40, 32) + [(100 + k, [x * 3e9 for x in v], lab) for k, v, lab in vectors(20, 32, 4)]
    rows += [(200 + k, [x * 1e300 for x in v], 7) for k, v, _ in vectors(5, 32, 5)] + [(300, [2.0**52] * 32, 8), (301, [-(2.0**60)] * 32, 8)]
    got = told(spark, rows, "double", entries=20)
    assert got == brute(rows, entries=20)
    assert any(r[2] is None for r in got) and any(r[2] is not None for r in got)


def test_short_empty_and_few_vectors(spark):
    rows = vectors(5, 20) + [(50, [], 1), (51, [1.0], 1), (52, [2.0] * 7, None)]
    assert told(spark, rows) == brute(rows)
    assert told(spark, [(1, [], 1), (2, [], 1)]) == brute([(1, [], 1), (2, [], 1)])
    assert told(spark, []) == [] and told(spark, [(1, None, 1)]) == []


def test_ties_go_to_the_lower_index(spark):
    rows = [(k, [float(k % 3)] * 16, 1) for k in range(70)]
    got = told(spark, rows)
    assert got == brute(rows)
    assert {r[1] for r in got} == {"00" * 16, "01" * 16, "02" * 16}


@pytest.mark.parametrize("kind", [np.int64, object])
@pytest.mark.parametrize("size", [1, 2, 3, 4, 7, 48, 64])
def test_nearest_equals_distances(kind, size):
    dice = np.random.default_rng(size)
    a, b = dice.integers(-9, 9, (200, size)).astype(kind), dice.integers(-9, 9, (32, size)).astype(kind)
    d = ((a[:, None] - b[None]) ** 2).sum(-1)
    index, far = nearest(a, b)
    want = [min((x, e) for e, x in enumerate(row)) for row in d.tolist()]
    assert [(int(x), int(e)) for x, e in zip(far, index, strict=True)] == want


def test_transform_is_in_sequency_order():
    for size in (1, 2, 8, 64):
        h = sequency(size)
        assert [int((np.diff(r) != 0).sum()) for r in h] == list(range(size))
        assert (h @ h.T == size * np.eye(size)).all()
    assert [padded(n) for n in (0, 1, 2, 3, 4, 5, 48)] == [1, 1, 2, 4, 4, 8, 64]


def test_whole_numbers_are_floors():
    assert whole(np.array([[-0.001, 0.00390625, -1.5]]), 256).tolist() == [[-1, 1, -384]]
    assert whole(np.array([[1e300]]), 256).tolist() == [[256 * int(1e300)]]


def test_options_are_checked(spark):
    with pytest.raises(ValueError, match="entries"):
        told(spark, vectors(3, 16), entries=257)

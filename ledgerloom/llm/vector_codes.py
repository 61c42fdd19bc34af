"""Product codes of vectors in whole numbers: nearest codebook entries by integer Walsh-Hadamard transforms.

Components become whole numbers, vectors are cut into parts, and each part is coded by the
nearest entry of its codebook.  Parts and entries are padded with zeros to a power of two
and transformed by Walsh-Hadamard matrices, which hold 1 and -1 alone.  The sum of squared
differences of two transforms is that of the parts times the padded length, and the first
terms in order of sequency hold most of it where components vary slowly.  So the terms are
summed in that order: the entry nearest by the first of them gives a bound by its whole
distance, and entries whose sum passes the bound drop out.  Sums never shrink, so this is
exact; nothing is rounded, and ties go to the lower index.

Tasks send one sum and count for each entry that they met, in limbs that no sum
overflows; Spark adds them up.  Only codebooks reach the driver: their size is fixed by the
number of entries and components, not by the number of vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize

#: Bits of a limb of a sum.
_LIMB = 48
#: Rows that are compared at once.
_ROWS = 4096


def sequency(size: int) -> np.ndarray:
    """Walsh-Hadamard matrix of a power of two, rows by their number of changes of sign."""
    h = np.ones((1, 1), np.int64)
    while len(h) < size:
        h = np.block([[h, h], [h, -h]])
    return h[np.argsort((np.diff(h, axis=1) != 0).sum(1), kind="stable")]


def padded(size: int) -> int:
    return 1 << max(0, size - 1).bit_length()


def _narrow(largest: int, size: int) -> bool:
    """Whether all sums over components of at most ``largest`` fit 64 bits: 4 * size**2 * largest**2 bounds them."""
    return 4 * padded(size) ** 2 * largest**2 < 1 << 62


def transformed(parts: np.ndarray) -> np.ndarray:
    """Sequency-ordered transform of the rows, each padded with zeros."""
    rows, size = parts.shape
    wide = np.zeros((rows, padded(size)), parts.dtype)
    wide[:, :size] = parts
    return wide.dot(sequency(wide.shape[1]).T.astype(parts.dtype))


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each part, of equals the lowest, and the squared distance; both arrays of one integer type."""
    a, b = transformed(parts), transformed(entries)
    size = a.shape[1]
    head = max(1, size // 4)
    sums = sum((a[:, None, k] - b[None, :, k]) ** 2 for k in range(head))
    guess = sums.argmin(1)
    bound = ((a - b[guess]) ** 2).sum(1)
    row, col = np.nonzero(sums <= bound[:, None])
    left = sums[row, col]
    for k in range(head, size):
        left = left + (a[row, k] - b[col, k]) ** 2
        stay = left <= bound[row]
        row, col, left = row[stay], col[stay], left[stay]
    order = np.lexsort((col, left, row)) if left.dtype != object else np.array(sorted(range(len(row)), key=lambda i: (row[i], left[i], col[i])), int)
    first = order[np.searchsorted(row[order], np.arange(len(a)))]
    return col[first], left[first] // size


def whole(values: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * x)`` of finite doubles, exactly; Python integers where 64 bits may not do. ``scale`` is a power of two."""
    if not values.size or np.abs(values).max() < 2.0**52 / scale:
        return np.floor(values * scale).astype(np.int64)
    exact = [(lambda n, d: scale * n // d)(*float(x).as_integer_ratio()) for x in values.ravel()]
    return np.array(exact, object).reshape(values.shape)


@dataclass(frozen=True)
class Codebooks:
    """``entries[part][entry]`` is a tuple of whole numbers; every part has equally many entries of ``size`` numbers."""

    entries: tuple[tuple[tuple[int, ...], ...], ...]
    size: int

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(x) for part in self.entries for e in part for x in e).encode()).hexdigest()

    def largest(self) -> int:
        return max((abs(x) for part in self.entries for e in part for x in e), default=0)

    def arrays(self, kind: type) -> list[np.ndarray]:
        return [np.array(part, kind).reshape(len(part), self.size) for part in self.entries]


def usable(vector: Column) -> Column:
    """Neither null nor with null or non-finite components."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.coalesce(F.forall(vector, finite), F.lit(False))


def _kept(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    named = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"), F.col(f"`{label_col}`").alias("label"))
    return named.where(usable(F.col("vector")))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of ``width`` doubles, short vectors filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width))
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def _blocks(batch: pa.RecordBatch, width: int, scale: int, parts: int, books: Codebooks) -> Iterator[tuple[int, int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]]:
    """For blocks of rows: first and last row, and for each part its numbers, codes and distances."""
    values = _matrix(batch.column(1), width)
    size = width // parts
    for at in range(0, len(values), _ROWS):
        block = whole(values[at : at + _ROWS], scale)
        most = max(books.largest(), int(np.abs(block).max()) if block.size else 0)
        kind = np.int64 if _narrow(most, size) else object
        cut = block.astype(kind).reshape(len(block), parts, size)
        yield at, at + len(block), [(cut[:, p], *nearest(cut[:, p], e)) for p, e in enumerate(books.arrays(kind))]


def _limbs(total: int) -> Iterator[tuple[int, int]]:
    """Signed limbs of a number, the lowest first; one at least."""
    sign, rest, k = (-1 if total < 0 else 1), abs(total), 0
    while rest or not k:
        yield k, sign * (rest & ((1 << _LIMB) - 1))
        rest, k = rest >> _LIMB, k + 1


def _improved(kept: DataFrame, books: Codebooks, width: int, scale: int) -> Codebooks:
    """Entries replaced by the floors of the means of their parts; unused ones stay."""
    parts = len(books.entries)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], list] = {}
        for batch in batches:
            for _, _, found in _blocks(batch, width, scale, parts, books):
                for p, (numbers, codes, _) in enumerate(found):
                    for e in np.unique(codes):
                        mine = numbers[codes == e]
                        one = total.setdefault((p, int(e)), [0, [0] * (width // parts)])
                        one[0] += len(mine)
                        one[1] = [x + int(y) for x, y in zip(one[1], mine.sum(0), strict=True)]
        # place -1 has the count
        rows = [(p, e, place, k, limb) for (p, e), (n, s) in total.items() for place, t in enumerate([n, *s], -1) for k, limb in _limbs(t)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 5, ["part", "entry", "place", "limb", "value"])

    found = kept.select("id", "vector").mapInArrow(sums, "part long, entry long, place long, limb long, value long")
    found = found.groupBy("part", "entry", "place", "limb").agg(F.sum(F.col("value").cast("decimal(19,0)")).alias("value"))
    total: dict[tuple[int, int, int], int] = {}
    for r in found.collect():  # entries times components, whatever the number of vectors
        key = (r.part, r.entry, r.place)
        total[key] = total.get(key, 0) + (int(r.value) << (_LIMB * r.limb))
    new = tuple(
        tuple(tuple(total[p, k, i] // total[p, k, -1] for i in range(len(old))) if (p, k, -1) in total else old for k, old in enumerate(part))
        for p, part in enumerate(books.entries)
    )
    return Codebooks(new, books.size)


def fit(kept: DataFrame, width: int, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> Codebooks:
    """Codebooks of ``kept (id, vector)``: they start as the vectors of the ``entries`` smallest ids; equal ids stand by vector."""
    first = kept.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).select("id", "vector").collect()
    size = width // parts
    padded_out = [list(r.vector) + [0.0] * (width - len(r.vector)) for r in first]
    numbers = [[int(x) for x in whole(np.array(v, float).reshape(1, -1), scale)[0]] for v in padded_out]
    books = Codebooks(tuple(tuple(tuple(v[p * size : (p + 1) * size]) for v in numbers) for p in range(parts)), size)
    for _ in range(rounds):
        books = _improved(kept, books, width, scale)
    return books


def _error(total: int) -> int | None:
    return total if total < 1 << 63 else None


def encode(kept: DataFrame, books: Codebooks, width: int, scale: int = 256) -> DataFrame:
    """``(id, label, code, error)``: indexes of the nearest entries in part order, and the squared distances summed."""
    parts = len(books.entries)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = np.zeros((batch.num_rows, parts), np.uint8), []
            for at, to, found in _blocks(batch, width, scale, parts, books):
                for p, (_, index, _) in enumerate(found):
                    codes[at:to, p] = index
                errors += [_error(sum(map(int, d))) for d in zip(*(d for _, _, d in found), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([bytes(c).hex() for c in codes], pa.string()), pa.array(errors, pa.int64())], ["id", "label", "code", "error"])

    out = kept.select("id", "label").schema.add("code", "string").add("error", "long")
    return kept.select("id", "vector", "label").mapInArrow(coded, out)


def report(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    parts: int = 16,
    entries: int = 64,
    rounds: int = 2,
    scale: int = 256,
    broadcast_rows: int = 100_000,
) -> DataFrame:
    """Per usable vector: id, ``code, error, label_error, codebooks_sha256``.

    Rows whose vector is null or holds null or non-finite components go.  All others are
    coded, whatever their size: numbers beyond 64 bits are worked out as Python integers, and
    ``error`` or ``label_error`` is null only where it does not fit a long itself.  Vectors are
    filled up with zeros to the longest length, raised to a multiple of ``parts``; ``entries``
    is at most 256.  Null labels are one label.  Repeated rows are coded each, and each may be
    an entry; null ids stand last for the first entries.  With fewer vectors than ``entries``
    all are entries; an empty table gives an empty one.  Other columns are not read.
    """
    if not 0 < entries <= 256 or scale & (scale - 1) or scale < 1:
        raise ValueError("entries must be 1 to 256, scale a power of two")
    kept = _kept(vectors, id_col, vector_col, label_col)
    longest = kept.agg(F.max(F.size("vector"))).first()[0] or 0
    width = -(-longest // parts) * parts
    books = fit(kept, width, parts, entries, rounds, scale)
    found = materialize(encode(kept, books, width, scale), "codes")
    total = found.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total"), F.count_if(F.col("error").isNull()).alias("lost"))
    fits = (F.col("lost") == 0) & (F.col("total") <= F.lit((1 << 63) - 1))
    total = total.select(F.col("label").alias("same"), F.when(fits, F.col("total").cast("long")).alias("label_error"))
    joined = found.join(broadcast_if_small(total, broadcast_rows), F.col("label").eqNullSafe(F.col("same")), "left")
    return joined.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def sql(parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> str:
    """The same codes in DuckDB, by the distances themselves; vectors are of one length, a multiple of ``parts``."""
    usable_rows = "embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"
    steps = [
        f"kept as (select vec_id, label, [floor({scale} * x::double)::hugeint for x in embedding] v from embeddings where {usable_rows})",
        f"cut as (select vec_id, label, p, v[p * (len(v) // {parts}) + 1:(p + 1) * (len(v) // {parts})] q from kept, range({parts}) t(p))",
        f"book0 as (select p, row_number() over (partition by p order by vec_id) - 1 e, q c from cut qualify e < {entries})",
    ]
    for k in range(rounds + 1):
        steps.append(f"near{k} as materialized (select vec_id, label, a.p p, q, (min((list_sum([(x - y) * (x - y) for x, y in list_zip(q, c)]), e))) best from cut a join book{k} b on a.p = b.p group by all)".replace("[(x - y) * (x - y) for x, y in list_zip(q, c)]", "list_transform(list_zip(q, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))"))
        if k < rounds:
            steps.append(f"""mean{k} as (select p, best[2] e, i, floor_div(sum(q[i]), count(*)) m from near{k}, range(1, len(q) + 1) t(i) group by all)""".replace("floor_div(sum(q[i]), count(*))", "(sum(q[i]) - ((sum(q[i]) % count(*)) + count(*)) % count(*)) // count(*)"))
            steps.append(f"book{k + 1} as (select b.p, b.e, coalesce(list(m order by i) filter (where m is not null), any_value(b.c)) c from book{k} b left join mean{k} a on a.p = b.p and a.e = b.e group by b.p, b.e)")
    return f"""
        with {", ".join(steps)},
        books as (select sha256(string_agg(array_to_string(c, ','), ',' order by p, e)) h from book{rounds}),
        codes as (select vec_id, label, string_agg(printf('%02x', best[2]), '' order by p) code, sum(best[1])::bigint error from near{rounds} group by vec_id, label)
        select vec_id, code, error, (sum(error) over (partition by label))::bigint label_error, (select h from books) codebooks_sha256 from codes"""

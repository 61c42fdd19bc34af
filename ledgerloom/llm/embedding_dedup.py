"""Embedding near-dedup by sorted projection passes.

Each pass hashes every vector by its own random hyperplanes, joins the bits to one key and
orders all vectors by it; close vectors share long prefixes and come to stand near each
other.  Every vector is compared with the ``window`` that follow it.  What is verified in
any pass is united.  Links inside a component that no window met are then found exactly,
tile by tile, so a large group of near copies loses none.
"""

from __future__ import annotations

from math import acos, ceil, log, log2, pi

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .graph import components
from .ngram_join import forest


def _unit(column: pa.Array) -> list[np.ndarray | None]:
    """Vectors of length one in double precision; None where a vector links with nothing."""
    out = []
    for v in column.to_pylist():
        x = None
        if v and None not in v:
            x = np.array(v, float)
            top = np.abs(x).max()
            x = x / top if np.isfinite(top) and top > 0 else None
            x = None if x is None or not np.isfinite(x).all() else x / np.linalg.norm(x)
        out.append(x)
    return out


def _planes(dim: int, passes: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, passes * bits))


def _project(batches, passes: int, bits: int, seed: int):
    """A row for each pass and usable vector: the pass, the key, the id and the vector."""
    known: dict[int, np.ndarray] = {}
    weight = 1 << np.arange(bits, dtype=np.int64)[::-1]
    for batch in batches:
        ids = batch.column(0).to_pylist()
        for low in range(0, len(ids), 1024):
            unit = _unit(batch.column(1).slice(low, 1024))
            for dim in {len(x) for x in unit if x is not None}:
                rows = [k for k, x in enumerate(unit) if x is not None and len(x) == dim]
                if dim not in known:
                    known[dim] = _planes(dim, passes, bits, seed)
                x = np.array([unit[k] for k in rows])
                key = ((x @ known[dim] > 0).reshape(len(rows), passes, bits) @ weight).T.reshape(-1)
                data = [v.tobytes() for v in x]
                n = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(np.arange(passes, dtype=np.int32), n)),
                        pa.array(np.full(n * passes, dim, np.int32)),
                        pa.array(key),
                        pa.array([ids[low + k] for k in rows] * passes, pa.int64()),
                        pa.array(data * passes, pa.binary()),
                    ],
                    names=["pass", "dim", "key", "id", "unit"],
                )


def _windows(batches, window: int, least: float, edge: bool):
    """Links between each vector and the ``window`` before it in the order of a partition.

    The first and last vectors of a partition come out as well (``part`` set), for the
    windows that reach over its ends; ``edge`` reads those.
    """
    from pyspark import TaskContext

    part = None if edge else TaskContext.get().partitionId()
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    names = ["src", "dst", "part", "pass", "dim", "key", "id", "unit"]
    tail: list[tuple] = []
    seen = 0

    def ends(rows):
        cols = list(zip(*rows, strict=True))
        none = [None] * len(rows)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([none, none, [part] * len(rows), *cols], kinds, strict=True)], names=names)

    for batch in batches:
        rows = list(zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True))
        if not edge and seen < window and rows:
            yield ends(rows[: window - seen])
        src, dst = [], []
        every = tail + rows
        first = len(tail)
        for low in range(first, len(every), 512):
            at = max(0, low - window)
            own = every[at : low + 512]
            group: dict[tuple, list[int]] = {}
            for k, r in enumerate(own):
                group.setdefault((r[0], r[1]), []).append(k)
            for ks in group.values():
                x = np.frombuffer(b"".join(own[k][4] for k in ks)).reshape(len(ks), -1)
                a, b = np.nonzero(x @ x.T >= least)
                place = np.array(ks)
                ok = (place[b] < place[a]) & (place[a] - place[b] <= window) & (place[a] + at >= low)
                kept = forest(place[a[ok]], place[b[ok]], len(own))  # what joins the same vectors; all links are counted later
                src += [own[k][3] for k, _ in kept]
                dst += [own[k][3] for _, k in kept]
        if src:
            none = [None] * len(src)
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64()), *(pa.array(none, k) for k in kinds[2:])], names=names)
        seen += len(rows)
        tail = every[-window:]
    if not edge and seen > window:
        yield ends(tail[-min(window, seen - window) :])


def _count(frame: pd.DataFrame, least: float) -> pd.DataFrame:
    """Per vector of a tile pair, how many of the other tile's vectors it links with."""
    frame = frame.drop_duplicates("id")
    i, j = int(frame["i"].iloc[0]), int(frame["j"].iloc[0])
    own = (frame["tile"] == i).to_numpy()
    ids, times = frame["id"].to_numpy(), frame["times"].to_numpy()
    left, right = (frame[own], frame[own]) if i == j else (frame[own], frame[~own])
    if not len(left) or not len(right):
        return pd.DataFrame({"id": [], "n": []}, dtype="int64")
    x = np.frombuffer(b"".join(left["unit"])).reshape(len(left), -1)
    y = np.frombuffer(b"".join(right["unit"])).reshape(len(right), -1)
    close = (x @ y.T >= least).astype(np.int64)
    if i == j:
        np.fill_diagonal(close, 0)
        return pd.DataFrame({"id": ids[own], "n": close @ times[own]})
    return pd.DataFrame({"id": np.concatenate([ids[own], ids[~own]]), "n": np.concatenate([close @ times[~own], close.T @ times[own]])})


def needed(n: int, least: float, window: int, recall: float = 0.99) -> tuple[int, int]:
    """Passes and bits of a key so that ``n`` spread vectors show a pair at the threshold with probability ``recall``.

    A random plane parts such a pair with probability ``acos(least) / pi``.  In a pass the
    pair meets if it shares about log2(n / window) bits, after which a window holds all that
    share them; keys are twice as long as ids need, so that dense regions part as well.
    """
    depth = max(1.0, log2(max(2.0, n / window)))
    share = (1 - acos(min(1.0, max(-1.0, least))) / pi) ** depth
    passes = 1 if share >= recall else ceil(log(1 - recall) / log(1 - share))
    return max(24, passes), min(62, max(40, ceil(2 * log2(max(2, n)))))


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    least: float = 0.95,
    passes: int | None = None,
    bits: int | None = None,
    window: int = 48,
    block: int = 1024,
    seed: int = 11,
) -> DataFrame:
    """``id_col, n_links, component_id, kept`` for every row.

    Vectors of equal direction bits are one node while links are searched; ``n_links``
    counts the other rows with cosine ``least`` or more, those equal to it included.
    Vectors that are null, empty, zero, or hold null or non-finite components link with
    nothing, and neither do vectors of different length.  ``component_id`` is the smallest
    id reachable.  Unless given, ``bits`` and ``passes`` follow the number of vectors: see
    :func:`needed`.  Rows with a null id get null links of their own; repeated ids are
    separate rows that share the id.  An empty table gives an empty one, other columns are
    ignored, and vectors may have any length.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    usable = F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    keyed = rows.select("id", "v", F.when(usable, F.xxhash64("v")).alias("node"))
    nodes = materialize(keyed.select("id", "node").groupBy("node", "id").agg(F.count("*").alias("rows")), "nodes")
    times = nodes.where("node is not null").groupBy("node").agg(F.sum("rows").alias("times"))
    one = keyed.where("node is not null").groupBy("node").agg(F.first("v").alias("v"))
    one = materialize(one, "vectors")
    asked = needed(one.count(), least, window)
    passes, bits = passes or asked[0], bits or asked[1]
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = one.select("node", "v").mapInArrow(lambda it: _project(it, passes, bits, seed), "pass int, dim int, key long, id long, unit binary")
    ordered = spread.repartitionByRange(max(parts, passes), "pass", "dim", "key", "id").sortWithinPartitions("pass", "dim", "key", "id")
    schema = "src long, dst long, part int, pass int, dim int, key long, id long, unit binary"
    met = materialize(ordered.mapInArrow(lambda it: _windows(it, window, least, False), schema), "windows")
    edges = met.where("part is not null").select("pass", "dim", "key", "id", "unit").distinct()
    # what stands at the ends of partitions: at most two windows of each, in one order again
    across = edges.repartitionByRange(passes, "pass").sortWithinPartitions("pass", "dim", "key", "id")
    more = across.mapInArrow(lambda it: _windows(it, 2 * window, least, True), schema)
    found = met.where("src is not null").select("src", "dst").union(more.where("src is not null").select("src", "dst"))
    joined = materialize(components(found), "components")
    # every link inside a component, tile by tile
    tiles = joined.groupBy("component").agg(F.ceil(F.count("*") / block).alias("tiles"))
    member = joined.join(tiles, "component").join(times, "node").select("node", "component", "tiles", "times")
    plain = one.select("node", "v").join(member, "node")
    unit = plain.mapInArrow(_as_units, "id long, component long, tiles long, times long, unit binary")
    tile = F.pmod(F.xxhash64("id"), F.col("tiles")).alias("tile")
    paired = unit.select("*", tile).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("other"))
    paired = paired.select("id", "component", "times", "unit", "tile", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"))
    links = paired.groupBy("component", "i", "j").applyInPandas(lambda f: _count(f, least), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    info = times.join(links.withColumnRenamed("id", "node"), "node", "left").join(joined, "node", "left")
    info = info.select("node", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "node").alias("root"))
    labelled = materialize(nodes.join(info, "node", "left"), "labelled")
    low = labelled.where("root is not null").groupBy("root").agg(F.min("id").alias("low"))
    out = labelled.join(low, "root", "left").withColumn("component_id", F.coalesce("low", "id"))
    out = out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", "rows", F.explode(F.sequence(F.lit(1).cast("long"), "rows")).alias("copy"))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def _as_units(batches):
    for batch in batches:
        unit = pa.array([x.tobytes() for x in _unit(batch.column(1))], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(batch.column(k) for k in (2, 3, 4)), unit], names=["id", "component", "tiles", "times", "unit"])

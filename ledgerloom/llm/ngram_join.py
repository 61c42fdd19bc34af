"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence.

Texts of equal shingle sets are one node.  A node can reach the threshold only with nodes
that share one of its rarest shingles (a prefix whose length follows from its size), so
those incidences alone are grouped by shingle; what stays alone there is discarded.  For
the order, all shingles are counted, and a filter of fixed size and the ``frequent`` most
common ones are told to all tasks; any order gives the same links.

Shingles of at most ``few`` nodes add up pair counts, and a pair goes on only if its size
allows the rest; shingles of more nodes tie each to their smallest one.  What is tied
makes candidate blocks, and inside a block the incidence matrix is multiplied by its
transpose, slice by slice, to count overlaps.  Blocks beyond ``block`` nodes are cut into
tiles and every pair of tiles is its own group, so no group grows with the data, and a
tile pair reports a spanning forest of its links, not the links.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import words
from .common import broadcast_if_small, freed, materialize, small_batches, trim
from .graph import components

#: Shingles are counted under the first 32 bits of their hashes.  Counts only order them.
_FLUSH, _FREQUENT = 4 << 20, 4


def _sets(raw, at, n):
    raw = words.LOWER[raw]
    start, end, first = words.spans(raw, at, words.SPACED)
    word = words.hashes(raw, start, end)
    for i in range(len(at) - 1):
        yield words.shingles(word, first[i], first[i + 1], n)


def _node(s: np.ndarray) -> int:
    """One id for equal sets; 0 for the empty set."""
    if not len(s):
        return 0
    return int(words.mix(np.array([words.mix(s).sum() + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def _cell(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(32)).astype(np.uint32)


def _packed(cells: np.ndarray, parts: int):
    """``(part, gaps, counts)``: sorted cells as 16-bit gaps, 65,535 standing for a longer one that follows."""
    cells, count = np.unique(cells, return_counts=True)
    count = np.minimum(count, 65535).astype(np.uint16)
    cut = np.searchsorted(cells, (np.arange(parts + 1, dtype=np.uint64) << np.uint64(32)) // np.uint64(parts))
    for k in range(parts):
        own = cells[cut[k] : cut[k + 1]]
        if len(own):
            gap = np.diff(own, prepend=np.uint32(0))
            short = np.minimum(gap, 65535).astype(np.uint16)
            yield k, short.tobytes(), gap[short == 65535].tobytes(), zlib.compress(count[cut[k] : cut[k + 1]].tobytes(), 1)


def _describe(batches, n, parts):
    """Per row its id, key, set size and node, and from time to time counts of shingles."""
    kinds = [pa.int64()] * 4 + [pa.int32()] + [pa.binary()] * 3
    names = ["id", "key", "size", "node", "part", "gaps", "wide", "counts"]

    def counted(cells):
        cols = list(zip(*_packed(np.concatenate(cells), parts), strict=True))
        none = [None] * len(cols[0])
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([none] * 4 + cols, kinds, strict=True)], names=names)

    cells, held = [], 0
    for batch in batches:
        for i, j, raw, at in words.pieces(batch.column(2)):
            size, node = [], []
            for s in _sets(raw, at, n):
                size.append(len(s))
                node.append(_node(s))
                if len(s):
                    cells.append(_cell(s))
                    held += len(s)
            none = [None] * (j - i)
            cols = [*(batch.column(k).slice(i, j - i) for k in (0, 1)), pa.array(size, pa.int64()), pa.array(node, pa.int64())]
            yield pa.RecordBatch.from_arrays([*cols, *(pa.array(none, k) for k in kinds[4:])], names=names)
            if held > _FLUSH:
                yield counted(cells)
                cells, held = [], 0
    if cells:
        yield counted(cells)


def _frequent(frame: pd.DataFrame, most: int) -> pd.DataFrame:
    """Of one part: which cells hold two documents or more, and the most frequent cells with their counts."""
    cells, counts = [], []
    for gaps, wide, count in zip(frame["gaps"], frame["wide"], frame["counts"], strict=True):
        gap = np.frombuffer(gaps, np.uint16).astype(np.uint32)
        gap[gap == 65535] = np.frombuffer(wide, np.uint32)
        cells.append(np.cumsum(gap, dtype=np.uint32))
        counts.append(np.frombuffer(zlib.decompress(count), np.uint16))
    cell, which = np.unique(np.concatenate(cells), return_inverse=True)
    total = np.bincount(which, weights=np.concatenate(counts)).astype(np.int64)
    first = int(cell[0]) >> 8  # a byte of the filter stands for 256 cells
    bits = np.zeros(((int(cell[-1]) >> 8) - first + 1) * 8, np.uint8)
    bits[(cell[total > 1] >> np.uint32(5)).astype(np.int64) - first * 8] = 1
    keep = np.flatnonzero(total >= _FREQUENT)
    keep = np.sort(keep[np.argsort(-total[keep], kind="stable")[:most]])
    totals = np.minimum(total[keep], (1 << 31) - 1).astype(np.int32)
    trim()
    return pd.DataFrame({"first": [first], "bits": [np.packbits(bits).tobytes()], "cells": [cell[keep].tobytes()], "totals": [totals.tobytes()]})


def _prefixes(batches, n, percent, shared):
    """The incidences of each node's rarest shingles; shingles of one document alone are left out."""
    bits, cells, totals = shared.value
    for batch in batches:
        for _, _, raw, at in words.pieces(batch.column(0)):
            out = []
            for s in _sets(raw, at, n):
                if not len(s):
                    continue
                keep = len(s) - (percent * len(s) + 99) // 100 + 1
                cell = _cell(s)
                often = (bits[cell >> np.uint32(8)] >> (np.uint8(7) - (cell >> np.uint32(5) & np.uint32(7)).astype(np.uint8)) & np.uint8(1)).astype(np.int32)
                if len(cells):
                    k = np.minimum(np.searchsorted(cells, cell), len(cells) - 1)
                    often = np.maximum(often, np.where(cells[k] == cell, totals[k], 0))
                rare = np.argsort(often, kind="stable")[:keep]
                place = np.flatnonzero(often[rare] > 0)
                if len(place):
                    out.append((s[rare[place]], np.full(len(place), _node(s)), place, np.full(len(place), len(s))))
            if out:
                token, node, place, size = map(np.concatenate, zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(token.view(np.int64)), pa.array(node, pa.int64()), pa.array(place, pa.int32()), pa.array(size, pa.int32())],
                    names=["token", "node", "place", "size"],
                )


def _members(batches, n):
    """One row per clustered node: its cluster and its whole set."""
    for batch in batches:
        for i, j, raw, at in words.pieces(batch.column(0)):
            sets = [s.tobytes() for s in _sets(raw, at, n)]
            kept = [batch.column(k).slice(i, j - i) for k in range(1, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sets, pa.binary())], names=[*batch.schema.names[1:], "items"])


def overlaps(left: list[np.ndarray], right: list[np.ndarray], columns: int = 8192) -> np.ndarray:
    """Overlap counts of every left with every right set: A times B transposed, by slices of columns."""
    sets = left + right
    size = np.array([len(s) for s in sets])
    value, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), size)
    shared = times[column] > 1
    row, column = row[shared], column[shared]
    column = (np.cumsum(times > 1) - 1)[column]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    got = np.zeros((len(left), len(right)), np.int64)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        i, j = np.searchsorted(column, [low, low + columns])
        a = np.zeros((len(sets), min(columns, int(column[-1]) + 1 - low)), np.float32)
        a[row[i:j], column[i:j] - low] = 1
        got += np.rint(a[: len(left)] @ a[len(left) :].T).astype(np.int64)
    return got


def forest(a: np.ndarray, b: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Links that suffice to join the same nodes."""
    parent, kept = list(range(n)), []

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = root(x), root(y)
        if p != q:
            parent[q] = p
            kept.append((x, y))
    return kept


def _product(frame: pd.DataFrame, percent: int) -> pd.DataFrame:
    frame = frame.drop_duplicates("node")
    i, j = int(frame["i"].iloc[0]), int(frame["j"].iloc[0])
    own = (frame["tile"] == i).to_numpy()
    sets = [np.frombuffer(x, np.uint64) for x in frame["items"]]
    at = np.arange(len(sets))
    left, right = at[own], (at[own] if i == j else at[~own])
    links = []
    if len(left) and len(right):
        size = np.array([len(s) for s in sets])
        tall = max(1, (1 << 22) // max(1, int(size.max())))  # long texts come in thinner slabs
        for p in range(0, len(left), tall):
            for q in range(0, len(right), tall):
                x, y = left[p : p + tall], right[q : q + tall]
                c = overlaps([sets[k] for k in x], [sets[k] for k in y])
                union = size[x][:, None] + size[y][None, :] - c
                a, b = np.nonzero(100 * c >= percent * union)
                a, b = x[a], y[b]
                links += forest(a[a != b], b[a != b], len(sets))
    kept = forest(np.array([a for a, _ in links], int), np.array([b for _, b in links], int), len(sets))
    node = frame["node"].to_numpy()
    trim()
    return pd.DataFrame({"src": node[[a for a, _ in kept]], "dst": node[[b for _, b in kept]]}, dtype="int64")


def _labelled(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n: int = 5,
    percent: int = 80,
    block: int = 512,
    frequent: int = 2_000_000,
    few: int = 32,
    broadcast_rows: int = 400_000,
) -> DataFrame:
    """``(id, key, size, root)`` of every row; ``root`` is one for all nodes that links join."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select("id", F.xxhash64("id", "text").alias("key"), "text")
    # about a shingle for each six bytes; a part counts some two million
    bytes_ = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = 1 << max(0, int(bytes_ // (12 << 20)).bit_length() - 1)
    described = rows.mapInArrow(
        lambda it: freed(_describe(it, n, parts)), "id long, key long, size long, node long, part int, gaps binary, wide binary, counts binary"
    )
    described = materialize(described, "sets")
    nodes = described.where("part is null").select("id", "key", "size", "node")
    counts = described.where("part is not null").select("part", "gaps", "wide", "counts")
    each = max(1, frequent // parts)
    found = counts.groupBy("part").applyInPandas(lambda f: _frequent(f, each), "first long, bits binary, cells binary, totals binary")
    bits = np.zeros(1 << 24, np.uint8)  # of fixed size
    hot = [(np.zeros(0, np.uint32), np.zeros(0, np.int32))]  # `frequent` cells at most
    for r in found.collect():
        own = np.frombuffer(r["bits"], np.uint8)
        bits[r["first"] : r["first"] + len(own)] |= own
        hot.append((np.frombuffer(r["cells"], np.uint32), np.frombuffer(r["totals"], np.int32)))
    cells, totals = map(np.concatenate, zip(*hot, strict=True))
    order = np.argsort(cells)
    shared = spark.sparkContext.broadcast((bits, cells[order], totals[order]))
    del bits, cells, totals, order, hot  # the driver needs them no more
    trim()
    token = Window.partitionBy("token")
    postings = (
        rows.select("text")
        .mapInArrow(lambda it: freed(_prefixes(it, n, percent, shared)), "token long, node long, place int, size int")
        .repartition("token")
        .dropDuplicates(["token", "node"])
        .select("*", F.count("*").over(token).alias("times"), F.min("node").over(token).alias("low"))
        .where("times > 1")
    )
    postings = materialize(postings, "postings")
    stars = postings.where(F.col("times") > few).select(F.col("node").alias("src"), F.col("low").alias("dst"))
    # rare shingles: count what each pair shares, and bound what it can share from where the last one stands
    rare = postings.where(F.col("times") <= few).groupBy("token").agg(F.collect_list(F.struct("node", "place", "size")).alias("all"))
    rare = rare.select(F.explode("all").alias("a"), "all").select("a", F.explode("all").alias("b")).where("a.node < b.node")
    pairs = rare.groupBy(F.col("a.node").alias("src"), F.col("b.node").alias("dst")).agg(
        F.count("*").alias("shared"), F.max("a.place").alias("p"), F.max("b.place").alias("q"), F.max("a.size").alias("m"), F.max("b.size").alias("k")
    )
    bound = F.col("shared") + F.least(F.col("m") - F.col("p"), F.col("k") - F.col("q")) - 1
    pairs = pairs.where(bound * (100 + percent) >= percent * (F.col("m") + F.col("k"))).select("src", "dst")
    edges = stars.union(pairs)
    clusters = materialize(components(edges).select("node", F.col("component").alias("cluster")), "clusters")
    counted = clusters.groupBy("cluster").agg(F.ceil(F.count("*") / block).alias("tiles"))
    one = nodes.groupBy("node").agg(F.min("key").alias("key"))
    wanted = one.join(clusters, "node").join(counted, "cluster").select("key", "node", "cluster", "tiles")
    wanted = materialize(wanted, "members")
    full = rows.join(broadcast_if_small(wanted, broadcast_rows), "key").select("text", "node", "cluster", "tiles")
    full = full.mapInArrow(lambda it: freed(_members(it, n)), "node long, cluster long, tiles long, items binary")
    tile = F.pmod(F.xxhash64("node"), F.col("tiles")).alias("tile")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("other")
    tiles = full.select("node", "cluster", "items", "tiles", tile).select("*", other)
    tiles = tiles.select("node", "cluster", "items", "tile", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"))
    links = tiles.groupBy("cluster", "i", "j").applyInPandas(lambda f: _product(f, percent), "src long, dst long")
    joined = components(links).select("node", F.col("component").alias("root"))
    labelled = nodes.join(joined, "node", "left").select("id", "key", "size", F.coalesce("root", "node").alias("root"))
    return materialize(labelled, "roots")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of ``docs``: ``id_col, n_shingles, component_id``.

    Texts are lower-cased (A-Z) and split at ASCII white space.  Two link when
    ``100 * overlap >= percent * union`` of their sets of n-word shingles; a text of fewer
    words is one shingle.  ``component_id`` is the smallest id reachable.  Texts without
    words (null or blank) link with nothing and stay their own component; a null id gives a
    null component where it is alone.  Repeated rows stay and share their result; other
    columns are ignored; an empty table gives an empty one.
    """
    labelled = _labelled(docs, id_col, text_col, **options)
    least = labelled.where("size > 0").groupBy("root").agg(F.min("id").alias("low"))
    got: Column = F.when(F.col("size") > 0, F.col("low")).otherwise(F.col("id"))
    return labelled.join(least, "root", "left").select(
        F.col("id").alias(id_col), F.col("size").alias("n_shingles"), got.alias("component_id")
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 400_000, **options) -> DataFrame:
    """The rows of ``docs``, all columns, less all but one of each class of near copies.

    The row of the smallest id stays, of rows repeated with id and text one.  Texts without
    words, null ones too, have no class and stay.  A null id comes before all others.  Texts
    are compared whole, of any length; other columns of any name are kept; an empty table
    gives an empty one.
    """
    rows = _labelled(docs, id_col, text_col, broadcast_rows=broadcast_rows, **options)
    best = rows.where("size > 0").groupBy("root").agg(F.min(F.struct("id", "key")).alias("best")).select("root", F.col("best.key").alias("stays"))
    judged = rows.where("size > 0").join(best, "root").select("key", (F.col("key") == F.col("stays")).alias("stays"))
    judged = judged.groupBy("key").agg(F.max("stays").alias("stays"), F.count("*").alias("times"))
    judged = materialize(judged.where("not stays or times > 1"), "judged")
    hidden = docs.select(F.struct(*docs.columns).alias("row"))
    hidden = hidden.withColumn("key", F.xxhash64(F.col("row").getField(id_col).cast("long"), F.col("row").getField(text_col).cast("string")))
    alone = hidden.join(broadcast_if_small(judged.select("key"), broadcast_rows), "key", "left_anti")
    repeated = hidden.join(broadcast_if_small(judged.where("stays").select("key"), broadcast_rows), "key", "left_semi").dropDuplicates(["key"])
    return alone.union(repeated).select("row.*")

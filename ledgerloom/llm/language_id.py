"""Language identification by prediction by partial matching over bytes.

Per language a context tree of order 3 counts which byte follows which bytes.  A byte's
code length is that of its longest seen context, after an escape from each longer one that
did not hold it (method C: escapes weigh as many as the context has different followers,
without exclusions).  The trees are frozen: every four-byte string that training met gets
its code length under every language once, and a text's score sums them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import freed, small_batches

ORDER = 3
_PAD = np.uint8(32)


def _grams(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The four bytes that end at each byte, spaces standing before a text, and the text of each."""
    raw = words.LOWER[raw]
    size = np.diff(at)
    doc = np.repeat(np.arange(len(size)), size)
    wide = np.full(len(raw) + ORDER * len(size), _PAD, np.uint8)
    place = np.arange(len(raw)) + ORDER * (doc + 1)
    wide[place] = raw
    four = wide[place].astype(np.uint32)
    for k in range(1, ORDER + 1):
        four |= wide[place - k].astype(np.uint32) << np.uint32(8 * k)
    return four, doc


def _counted(batches):
    """Four-byte strings of each language's texts with their counts."""
    for batch in batches:
        lang = np.array(batch.column(0).to_pylist(), object)
        for i, j, raw, at in words.pieces(batch.column(1)):
            four, doc = _grams(raw, at)
            for name in set(lang[i:j]):
                gram, times = np.unique(four[(lang[i:j] == name)[doc]], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(gram), pa.string()), pa.array(gram.astype(np.int64)), pa.array(times, pa.int64())], names=["lang", "gram", "n"]
                )


class Tree:
    """Frozen statistics of one language: for each order the counts of (context, byte) and of contexts."""

    def __init__(self, gram: np.ndarray, times: np.ndarray):
        self.levels = []
        for k in range(ORDER + 1):
            key, which = np.unique(gram & np.uint32((1 << 8 * (k + 1)) - 1), return_inverse=True)
            n = np.bincount(which, weights=times)
            context, which = np.unique(key >> np.uint32(8), return_inverse=True)
            self.levels.append((key, n, context, np.bincount(which, weights=n), np.bincount(which)))

    def bits(self, gram: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each string after the others, in bits."""
        out, left = np.zeros(len(gram)), np.arange(len(gram))
        for k in range(ORDER, -1, -1):
            key, n, context, total, kinds = self.levels[k]
            own = gram[left] & np.uint32((1 << 8 * (k + 1)) - 1)
            c = np.minimum(np.searchsorted(context, own >> np.uint32(8)), len(context) - 1)
            seen = context[c] == own >> np.uint32(8)
            x = np.minimum(np.searchsorted(key, own), len(key) - 1)
            hit = key[x] == own
            all_ = total[c] + kinds[c]
            out[left[hit]] += np.log2(all_[hit] / n[x[hit]])
            miss = seen & ~hit
            out[left[miss]] += np.log2(all_[miss] / kinds[c[miss]])
            left = left[~hit]
        out[left] += 8.0  # a byte that training never met
        return out


class Model:
    """All languages' code lengths of the strings that training met, and the trees for others."""

    def __init__(self, counts: pd.DataFrame):
        self.langs = sorted(counts["lang"].unique())
        self.trees = []
        for name in self.langs:
            own = counts[counts["lang"] == name]
            self.trees.append(Tree(own["gram"].to_numpy().astype(np.uint32), own["n"].to_numpy().astype(float)))
        self.gram = np.unique(counts["gram"].to_numpy().astype(np.uint32)) if len(counts) else np.zeros(0, np.uint32)
        self.bits = np.stack([t.bits(self.gram) for t in self.trees], 1).astype(np.float32) if self.langs else np.zeros((0, 0), np.float32)
        # pairs of bytes are numbered, so a table finds a string by two of them
        pairs = np.unique(np.concatenate([self.gram >> np.uint32(16), self.gram & np.uint32(0xFFFF)]))
        self.pair = np.zeros(1 << 16, np.int32)
        self.pair[pairs] = np.arange(1, len(pairs) + 1)
        self.width = len(pairs) + 1
        self.table = None

    def find(self, four: np.ndarray) -> np.ndarray:
        """Number of each string, or -1."""
        if not len(self.gram):
            return np.full(len(four), -1)
        if self.width > 6000:  # too many pairs for a table: search
            k = np.minimum(np.searchsorted(self.gram, four), len(self.gram) - 1)
            return np.where(self.gram[k] == four, k, -1)
        if self.table is None:
            self.table = np.full(self.width * self.width, -1, np.int32)
            self.table[self.pair[self.gram >> np.uint32(16)] * self.width + self.pair[self.gram & np.uint32(0xFFFF)]] = np.arange(len(self.gram))
            self.table[: self.width] = self.table[:: self.width] = -1
        return self.table[self.pair[four >> np.uint32(16)] * self.width + self.pair[four & np.uint32(0xFFFF)]]

    def lengths(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Code length of every text under every language, in bits."""
        four, doc = _grams(raw, at)
        docs = len(at) - 1
        where = self.find(four)
        known = where >= 0
        out = np.zeros((docs, len(self.langs)))
        rare, which = np.unique(four[~known], return_inverse=True)
        for k, tree in enumerate(self.trees):
            out[:, k] = np.bincount(doc[known], weights=self.bits[where[known], k], minlength=docs)
            if len(rare):
                out[:, k] += np.bincount(doc[~known], weights=tree.bits(rare)[which], minlength=docs)
        return out


def _letters(column: pa.Array, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each text holds a letter (Unicode category L)."""
    low = words.LOWER[raw]
    ascii_ = np.concatenate([[0], np.cumsum((low >= 97) & (low <= 122))])
    out = ascii_[at[1:]] > ascii_[at[:-1]]
    for k in np.flatnonzero(~out & (np.diff(at) > 0)).tolist():
        out[k] = any(c.isalpha() for c in column[k].as_py() or "")
    return out


def _predict(batches, shared, at_text: int, keep: int):
    model: Model = shared.value
    for batch in batches:
        for i, j, raw, at in words.pieces(batch.column(at_text)):
            name, score = np.full(j - i, "und", object), np.zeros(j - i)
            if model.langs:
                bits = model.lengths(raw, at)
                order = bits.argmin(1)
                best = bits[np.arange(j - i), order]
                name = np.array(model.langs, object)[order]
                # the languages' shares of the probability of the text, all equally likely before
                score = 1 / np.exp2(np.maximum(best[:, None] - bits, -1000)).sum(1)
                none = ~_letters(batch.column(at_text).slice(i, j - i), raw, at)
                name[none], score[none] = "und", 0
            per_byte = np.where(np.diff(at) > 0, (best if model.langs else score) / np.maximum(np.diff(at), 1), 0.0)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k).slice(i, j - i) for k in range(keep)), pa.array(name, pa.string()), pa.array(score), pa.array(per_byte)],
                names=[*batch.schema.names[:keep], "p0", "p1", "p2"],
            )


def train(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", most: int = 3000) -> Model:
    """Fit the trees on ``labelled``.

    Of each language about ``most`` rows are used at most, whole texts, chosen by a hash of
    the text; null languages and texts are left out.
    """
    small_batches(labelled.sparkSession)
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    counts = dict(rows.groupBy("lang").count().collect())  # a row for each language
    if not counts:
        return Model(pd.DataFrame({"lang": [], "gram": [], "n": []}))
    share = F.create_map(*(F.lit(x) for name, n in counts.items() for x in (name, min(1.0, most / n))))
    some = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < F.element_at(share, F.col("lang")) * (1 << 20))
    got = some.mapInArrow(lambda it: freed(_counted(it)), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    return Model(got.toPandas())  # bounded by the sample: its distinct four-byte strings


def predict(docs: DataFrame, model: Model, keep: list, text_col: str = "text") -> DataFrame:
    """``keep`` (columns) of every row with ``lang_pred, score, bits_per_byte``.

    ``lang_pred`` is the language of the shortest code, the first by name of equals; it is
    ``und`` with score 0 if the text is null or has no letter, or nothing was learned.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    cols = [F.col(c) if isinstance(c, str) else c for c in keep]
    wide = docs.select(*(c.alias(f"k{i}") for i, c in enumerate(cols)), F.col(text_col).cast("string").alias("text"))
    kinds = ", ".join(f"k{i} {f.dataType.simpleString()}" for i, f in enumerate(wide.schema.fields[:-1]))
    n = len(cols)
    return wide.mapInArrow(lambda it: freed(_predict(it, shared, n, n)), f"{kinds}, p0 string, p1 double, p2 double")


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """``id_col, held_out, lang_pred, score, bits_per_byte`` of every row.

    Rows whose ``crc32(id as text) mod 4`` is 2 are held out of training; a null id is not.
    Repeated rows stay; other columns are ignored; an empty table gives an empty one.
    Texts are scored whole, of any length; of equal codes the first language by name wins.
    """
    model = train(docs.where(~held_out(id_col)), lang_col, text_col, **options)
    got = predict(docs, model, [F.col(id_col), held_out(id_col)], text_col)
    return got.select(F.col("k0").alias(id_col), F.col("k1").alias("held_out"), F.col("p0").alias("lang_pred"), F.col("p1").alias("score"), F.col("p2").alias("bits_per_byte"))


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = 0.5, **options) -> DataFrame:
    """The rows of ``docs``, all columns, that have a language: not ``und``, and of score ``least`` at least.

    Null, empty and letterless texts have none and go, whatever their ``lang``; a null
    ``lang`` only keeps a row out of training.  Whole texts are scored, of any length.
    Equally short codes go to the first language by name.  Repeated rows each get the same
    answer, other columns of any name are kept, an empty table gives an empty one.
    """
    model = train(docs.where(~held_out(id_col)), lang_col, text_col, **options)
    got = predict(docs, model, [F.struct(*docs.columns)], text_col)
    return got.where((F.col("p0") != "und") & (F.col("p1") >= least)).select("k0.*")

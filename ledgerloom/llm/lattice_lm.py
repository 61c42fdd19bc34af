"""Language-model score: marginal likelihood of a text over all its subword segmentations.

The pieces are those of an existing public byte-level vocabulary.  Their unigram scores
start from the vocabulary's own rank order and are fitted to the training words by
expectation maximisation.  Pieces do not cross white space, so a text's marginal is the
product of its words' marginals and the end's, and every distinct word is summed over its
lattice once, by a forward recursion in log space.

Word counts grow with the corpus and are never gathered: the most frequent ``head`` words
(a bounded table) travel to the documents, all others are looked up by a join on the
word's hash, at one row per document and word.
"""

from __future__ import annotations

import json
from math import log10

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import materialize

_STARTS = 4096  # places of a word that are looked up at a time
_B = np.uint64(0x9E3779B97F4A7C15)


def _byte_of() -> dict[str, int]:
    """The printable characters that byte-level vocabularies write for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def load_pieces(path: str) -> list[bytes]:
    """Pieces of a byte-level vocabulary file, most frequent first; its special tokens are left out."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    special = {t["content"] for t in found.get("added_tokens", [])}
    byte = _byte_of()
    order = sorted(found["model"]["vocab"].items(), key=lambda x: x[1])
    return [bytes(byte[c] for c in piece) for piece, _ in order if piece not in special]


class Lattice:
    """Piece scores (natural logs), with the end of text as one more outcome."""

    def __init__(self, pieces: list[bytes], counts: np.ndarray, smooth: float = 0.1):
        mass = counts + smooth
        logp = np.log(mass) - np.log(mass.sum())
        self.end = float(logp[-1])
        self.size = len(pieces)
        self.by_length: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        lengths = np.array([len(p) for p in pieces])
        for n in np.unique(lengths):
            own = np.flatnonzero(lengths == n)
            h = np.zeros(len(own), np.uint64)
            grid = np.frombuffer(b"".join(pieces[k] for k in own), np.uint8).reshape(len(own), n)
            for k in range(n):
                h = h * _B + words._VALUE[grid[:, k]]
            order = np.argsort(h)
            self.by_length.append((int(n), h[order], logp[own[order]], own[order]))

    def _scores(self, grid: np.ndarray, low: int, high: int):
        """``(length, scores, pieces)`` of all pieces that start in ``[low, high)``; no piece scores -inf."""
        width = grid.shape[1]
        value = words._VALUE[grid[:, low : min(width, high + self.by_length[-1][0])]]
        h, have, out = np.zeros((len(grid), high - low), np.uint64), 0, []
        for n, known, score, piece in self.by_length:
            while have < n:
                starts = min(high, width - have) - low
                if starts <= 0:
                    return out
                h = h[:, :starts] * _B + value[:, have : have + starts]
                have += 1
            if h.shape[1] > width - n + 1 - low:
                h = h[:, : max(0, width - n + 1 - low)]
            if not h.shape[1]:
                return out
            k = np.minimum(np.searchsorted(known, h), len(known) - 1)
            hit = known[k] == h
            if hit.any():
                out.append((n, np.where(hit, score[k], -np.inf), np.where(hit, piece[k], -1)))
        return out

    def forward(self, grid: np.ndarray) -> np.ndarray:
        """Log marginals of all prefixes of words of one length, a row each."""
        alpha = np.full((len(grid), grid.shape[1] + 1), -np.inf)
        alpha[:, 0] = 0
        with np.errstate(invalid="ignore"):
            for low in range(0, grid.shape[1], _STARTS):
                high = min(low + _STARTS, grid.shape[1])
                found = self._scores(grid, low, high)
                for i in range(low, high):
                    for n, score, _ in found:
                        if i - low < score.shape[1]:
                            np.logaddexp(alpha[:, i + n], alpha[:, i] + score[:, i - low], out=alpha[:, i + n])
        return alpha

    def expected(self, grid: np.ndarray, times: np.ndarray, counts: np.ndarray) -> None:
        """Add the expected piece counts of words of one length that occur ``times``."""
        alpha = self.forward(grid)
        beta = np.full(alpha.shape, -np.inf)
        beta[:, -1] = 0
        total = alpha[:, -1:]
        with np.errstate(invalid="ignore"):
            for low in range((grid.shape[1] - 1) // _STARTS * _STARTS, -1, -_STARTS):
                high = min(low + _STARTS, grid.shape[1])
                found = self._scores(grid, low, high)
                for i in range(high - 1, low - 1, -1):
                    for n, score, _ in found:
                        if i - low < score.shape[1]:
                            np.logaddexp(beta[:, i], beta[:, i + n] + score[:, i - low], out=beta[:, i])
                for n, score, piece in found:
                    s = score.shape[1]
                    share = np.exp(alpha[:, low : low + s] + score + beta[:, low + n : low + n + s] - total) * times[:, None]
                    hit = piece >= 0
                    counts += np.bincount(piece[hit], weights=share[hit], minlength=len(counts))


def by_length(column: pa.Array):
    """``(rows, grid)`` of the words of each length, a space put before each word."""
    flat = column.cast(pa.large_binary())
    _, offsets, data = flat.buffers()
    at = np.frombuffer(offsets, np.int64)[flat.offset : flat.offset + len(flat) + 1]
    raw = np.frombuffer(data, np.uint8)
    size = np.diff(at)
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        for k in range(0, len(rows), max(1, (1 << 20) // (int(n) + 1))):
            own = rows[k : k + max(1, (1 << 20) // (int(n) + 1))]
            grid = np.full((len(own), n + 1), 32, np.uint8)
            grid[:, 1:] = raw[at[own][:, None] + np.arange(n)]
            yield own, grid


def _count(batches):
    """Distinct words of each piece of a partition, with their counts in training and in all texts."""
    for batch in batches:
        train = ~batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        for i, j, raw, at in words.pieces(batch.column(0)):
            raw = words.LOWER[raw]
            start, end, first = words.spans(raw, at, words.SPACED)
            h, one, which = np.unique(words.hashes(raw, start, end), return_index=True, return_inverse=True)
            known = np.bincount(which, weights=np.repeat(train[i:j], np.diff(first)), minlength=len(h)).astype(np.int64)
            times = np.bincount(which, minlength=len(h))
            text = raw.tobytes()
            word = [text[a:b] for a, b in zip(start[one].tolist(), end[one].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), pa.array(word, pa.binary()), pa.array(known), pa.array(times, pa.int64())], names=["h", "word", "c", "n"]
            )


def _expect(batches, shared):
    lattice: Lattice = shared.value
    counts = np.zeros(lattice.size)
    for batch in batches:
        times = batch.column(1).to_numpy()
        for rows, grid in by_length(batch.column(0)):
            lattice.expected(grid, times[rows].astype(float), counts)
    piece = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int32()), pa.array(counts[piece])], names=["piece", "expected"])


def _marginals(batches, shared):
    lattice: Lattice = shared.value
    for batch in batches:
        got = np.zeros(batch.num_rows)
        for rows, grid in by_length(batch.column(1)):
            got[rows] = lattice.forward(grid)[:, -1] / np.log(10)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(got)], names=["h", "c", "n", "logp"])


def _score(batches, shared):
    """Per document what its head words give, and its other words with their counts."""
    h, c, logp, base, end = shared.value
    here, made = TaskContext.get().partitionId() << 33, 0
    for batch in batches:
        for i, j, raw, at in words.pieces(batch.column(2)):
            raw = words.LOWER[raw]
            start, stop, first = words.spans(raw, at, words.SPACED)
            word, docs = words.hashes(raw, start, stop), j - i
            doc = np.repeat(np.arange(docs), np.diff(first))
            k = np.minimum(np.searchsorted(h, word), max(0, len(h) - 1))
            head = h[k] == word if len(h) else np.zeros(len(word), bool)
            k, own = k[head], doc[head]
            sums = [np.bincount(own, weights=x[k], minlength=docs).astype(float) for x in ((c > 0).astype(float), base, logp)]
            order = np.lexsort((word[~head], doc[~head]))
            w, d = word[~head][order], doc[~head][order]
            new = np.ones(len(w), bool)
            new[1:] = (w[1:] != w[:-1]) | (d[1:] != d[:-1])
            at_new = np.flatnonzero(new)
            times = np.diff(np.append(at_new, len(w))).astype(np.int32)
            rest = pa.StructArray.from_arrays([pa.array(w[at_new].view(np.int64)), pa.array(times)], names=["h", "n"])
            cut = np.searchsorted(d[at_new], np.arange(docs + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(here + made + np.arange(docs)),
                    batch.column(0).slice(i, docs),
                    batch.column(1).slice(i, docs),
                    pa.array(np.diff(first) + 1, pa.int64()),
                    pa.array(np.rint(sums[0]).astype(np.int64)),
                    pa.array(sums[1]),
                    pa.array(sums[2] + end),
                    pa.ListArray.from_arrays(pa.array(cut), rest),
                ],
                names=["row", "id", "held_out", "n_tokens", "n_known", "base", "logp", "rest"],
            )
            made += docs


def lattice_scores(
    docs: DataFrame,
    vocabulary: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    rounds: int = 2,
    head: int = 200_000,
) -> DataFrame:
    """Score every row of ``docs``; one row each.

    Returns ``id_col, held_out, n_tokens, n_known, train_tokens, base_score, score``.  Rows
    whose ``crc32(id as text) mod 5`` is 1 are held out: nothing is learned from them.  A
    null id counts as not held out; a null text is empty and has the end only.  Texts are
    lower-cased (A-Z) and split at ASCII white space.  ``base_score`` is the additively
    smoothed word unigram's log10 probability, ``score`` the lattice model's log10
    probability of the words and the end.  ``vocabulary`` names a byte-level vocabulary
    file, read on the driver.  ``rounds`` of expectation maximisation fit the piece scores;
    without training words they stay at the vocabulary's rank order.  Repeated rows stay,
    other columns are ignored, an empty table gives an empty one.  Texts are scored whole,
    of any length; words of equal counts are scored alike, whichever way they reach a task.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 1, F.lit(False)).alias("held_out"),
        F.col(text_col).cast("string").alias("text"),
    )
    seen = rows.select("text", "held_out").mapInArrow(_count, "h long, word binary, c long, n long")
    seen = materialize(seen.groupBy("h", "word").agg(F.sum("c").alias("c"), F.sum("n").alias("n")), "words")
    ends = rows.where(~F.col("held_out")).count()
    known, tokens = seen.agg(F.count_if(F.col("c") > 0), F.coalesce(F.sum("c"), F.lit(0))).first()
    total, distinct = tokens + ends, known + (ends > 0)
    below = total + 0.5 * (distinct + 1)

    pieces = load_pieces(vocabulary)
    scale = max(1.0, float(tokens))
    counts = scale / (10.0 + np.arange(len(pieces) + 1))
    counts[-1] = ends
    for _ in range(rounds if tokens else 0):
        shared = spark.sparkContext.broadcast(Lattice(pieces, counts))
        got = seen.where("c > 0").select("word", "c").mapInArrow(lambda it, s=shared: _expect(it, s), "piece int, expected double")
        counts = np.zeros(len(pieces) + 1)
        counts[-1] = ends
        for piece, expected in got.groupBy("piece").agg(F.sum("expected")).collect():  # a row for each piece at most
            counts[piece] = expected
    lattice = Lattice(pieces, counts)
    shared = spark.sparkContext.broadcast(lattice)
    scored = materialize(seen.mapInArrow(lambda it: _marginals(it, shared), "h long, c long, n long, logp double"), "marginals")

    # the most frequent words, `head` at most: counts fall into a few hundred bands, and whole bands are taken
    band = F.floor(F.log2("n") * 16).cast("int")
    least, room = None, head
    for at, words_in in sorted(scored.groupBy(band.alias("band")).count().collect(), reverse=True):
        if words_in > room:
            break
        least, room = at, room - words_in
    top = scored.where(band >= least if least is not None else F.lit(False)).select("h", "c", "logp").toPandas()
    top = top.iloc[np.argsort(top["h"].to_numpy(np.int64).view(np.uint64))]
    h, c, logp = top["h"].to_numpy(np.int64).view(np.uint64), top["c"].to_numpy(np.int64), top["logp"].to_numpy(float)
    sent = spark.sparkContext.broadcast((h, c, logp, np.log10((c + 0.5) / below), lattice.end / np.log(10)))
    part = rows.mapInArrow(
        lambda it: _score(it, sent),
        f"row long, id {rows.schema['id'].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, base double, logp double, rest array<struct<h:long,n:int>>",
    )
    part = materialize(part, "scores")
    rest = part.select("row", F.inline("rest")).withColumnRenamed("n", "times")
    own = F.col("times") * F.log10((F.col("c") + 0.5) / F.lit(below))
    rest = rest.join(scored.select("h", "c", "logp"), "h").groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more"),
        F.sum(own).alias("base_more"),
        F.sum(F.col("times") * F.col("logp")).alias("logp_more"),
    )
    end = log10((ends + 0.5) / below)
    plus = lambda c: F.coalesce(F.col(c), F.lit(0))
    return part.drop("rest").join(rest, "row", "left").select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("n_known") + plus("more") + (1 if ends else 0)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + plus("base_more") + F.lit(end)).alias("base_score"),
        (F.col("logp") + plus("logp_more")).alias("score"),
    )

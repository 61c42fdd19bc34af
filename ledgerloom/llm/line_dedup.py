"""Fuzzy line dedup in DataFrame functions only: MinHash, banding, exact Jaccard, components.

Equal lines are one.  Each distinct line is cut into character shingles by a generator
over its bytes, where a shingle is a slice at a fixed place.  A shingle's hash deals
it to one of ``parts`` parts, and one aggregation keeps eight minima of each part under
different orders.  Four of them name a bucket, and each part has four such bands: the two
halves of its minima and two that cross them.

Pairs are compared by their exact shingle sets, and what passes joins components, in two
rounds.  First every line of a bucket meets the first and the one before it, which joins
groups of near copies at a cost in proportion to their size.  Then all pairs of a bucket
that are still in different components meet: a bucket is cut into tiles of about ``tile``
lines and each pair of tiles is its own group, so no group grows with the data.  A pair
that shares several buckets is compared in one of them.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize
from .graph import components

#: Constants of the eight orders: the nearest hash to one of these, by exclusive or, is the least.
_TURNS = (0x2545F491, 0x5BD1E995, 0x1B873593, 0x6C078965, 0x38495AB5, 0x7FEB352D, 0x119DE1F3, 0x44412A53)
#: Which minima a band takes.
_BANDS = ((0, 1, 2, 3), (4, 5, 6, 7), (0, 1, 4, 5), (2, 3, 6, 7))


def _starts(line: Column, n: int) -> Column:
    """Starts of the shingles of a line in its UTF-16 form; a shorter line has one."""
    return F.sequence(F.lit(0), F.greatest(F.floor(F.octet_length(line) / 2).cast("int") - n, F.lit(0)))


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(key, id, pos, h, norm)`` of every line that is not blank; ``key`` stands for a row's id and text."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select(F.xxhash64("id", "text").alias("key"), "id", F.split("text", "\n", -1).alias("lines"))
    lines = rows.select("key", "id", F.posexplode("lines").alias("pos", "line"))
    lines = lines.select("key", "id", "pos", F.lower(F.trim("line")).alias("norm")).where("norm != ''")
    return lines.select("key", "id", "pos", F.xxhash64("norm").alias("h"), "norm")


def _buckets(lines: DataFrame, n: int, parts: int) -> DataFrame:
    """``(h, bucket)``: the buckets of each distinct line, four for each part of its shingles.

    These are shingles of bytes: the same as of characters in ASCII, and no less alike in other texts.
    """
    raw = lines.groupBy("h").agg(F.first("norm").alias("norm")).select("h", F.col("norm").cast("binary").alias("raw"))
    each = raw.select("h", "raw", F.explode(F.sequence(F.lit(1), F.greatest(F.octet_length("raw") - (n - 1), F.lit(1)))).alias("i"))
    each = each.select("h", F.xxhash64(F.substring("raw", F.col("i"), F.lit(n))).alias("x"))
    halves = [F.col("x").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int").alias("y"), F.shiftrightunsigned("x", 33).cast("int").alias("z")]
    each = each.select("h", F.pmod(F.shiftright("x", 29), F.lit(parts)).cast("int").alias("part"), *halves)
    low = each.groupBy("h", "part").agg(*(F.min(F.col("yz"[k % 2]).bitwiseXOR(F.lit(turn))).alias(f"m{k}") for k, turn in enumerate(_TURNS)))
    keys = F.array(*(F.xxhash64("part", F.lit(b), *(f"m{k}" for k in band)) for b, band in enumerate(_BANDS)))
    return low.select("h", F.explode(keys).alias("bucket"))


def _tied(buckets: DataFrame) -> DataFrame:
    """``(bucket, h, n)`` of the lines that are not alone in a bucket of ``n``."""
    return buckets.select("bucket", "h", F.count("*").over(Window.partitionBy("bucket")).alias("n")).where("n > 1")


def _chained(tied: DataFrame) -> DataFrame:
    """Distinct pairs ``(a, b)``: every line with the first of its bucket and the one before it.

    First stand the lines that meet most others, as the model of many near copies does.
    """
    met = tied.groupBy("h").agg(F.sum("n").alias("met"))
    w = Window.partitionBy("bucket").orderBy(F.desc("met"), "h")
    first = F.first("h").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    near = tied.join(met, "h").select("h", first.alias("first"), F.lag("h").over(w).alias("before")).where("before is not null")
    pairs = near.select(F.explode(F.array_distinct(F.array("first", "before"))).alias("x"), "h")
    return pairs.select(F.least("x", "h").alias("a"), F.greatest("x", "h").alias("b")).distinct()


def _set(line: Column, n: int) -> Column:
    """Hashes of the shingles of a line; a lambda binds its bytes, which would be copied for each shingle else."""

    def shingled(wide: Column) -> Column:
        return F.transform(_starts(wide, n), lambda i: F.xxhash64(F.substring(wide, i * 2 + 1, F.lit(2 * n))))

    return F.element_at(F.transform(F.array(F.encode(line, "UTF-16BE")), shingled), 1)


def _alike(a: Column, b: Column, na: Column, nb: Column, percent: int) -> Column:
    """Whether sets of ``na`` and ``nb`` shingles reach the similarity."""
    return F.size(F.array_intersect(a, b)) * (100 + percent) >= (na + nb) * percent


def _near_in_size(na: Column, nb: Column, percent: int) -> Column:
    return F.least(na, nb) * 100 >= F.greatest(na, nb) * percent


def _bits(line_set: Column) -> Column:
    """1024 bits of a set in an array of longs: each shingle sets the one that its hash names."""

    def word(w: Column) -> Column:
        own = F.filter(line_set, lambda x: x.bitwiseAND(F.lit(15)) == w)
        bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(x, 4).bitwiseAND(F.lit(63)).cast("int"))
        return F.aggregate(own, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(bit(x)))

    return F.transform(F.sequence(F.lit(0), F.lit(15)), word)


def _may_be_alike(a: Column, b: Column, percent: int) -> Column:
    """False only where the sets cannot reach the similarity: a bit of one alone is a shingle of it alone."""

    def alone(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x.bits, y.bits, lambda v, w: F.bit_count(v.bitwiseAND(F.bitwise_not(w)))), F.lit(0), lambda acc, v: acc + v)

    return F.least(a.k - alone(a, b), b.k - alone(b, a)) * (100 + percent) >= (a.k + b.k) * percent


def _verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Pairs whose shingle sets reach the similarity."""
    both = pairs.join(texts.select("h", "norm", "k").toDF("a", "left", "na"), "a").join(texts.select("h", "norm", "k").toDF("b", "right", "nb"), "b")
    like = _alike(_set(F.col("left"), n), _set(F.col("right"), n), F.col("na"), F.col("nb"), percent)
    return both.where(_near_in_size(F.col("na"), F.col("nb"), percent)).where(like).select(F.col("a").alias("src"), F.col("b").alias("dst"))


def _apart(tied: DataFrame, near: DataFrame, texts: DataFrame, n: int, percent: int, tile: int) -> DataFrame:
    """Links ``(src, dst)`` of lines that share a bucket and no component of ``near``.

    Buckets of up to three lines have been compared whole.  The text travels once to each
    group of two tiles, not once to each pair.
    """
    found = tied.where("n > 3").join(near.withColumnRenamed("node", "h"), "h", "left")
    found = found.select("bucket", "h", "n", F.coalesce("component", "h").alias("c"))
    mixed = found.groupBy("bucket").agg(F.max("n").alias("n"), F.min("c").alias("low"), F.max("c").alias("high")).where("low != high")
    cut = found.select("bucket", "h", "c").join(mixed.select("bucket", F.ceil(F.col("n") / tile).alias("tiles")), "bucket")
    cut = cut.select("bucket", "h", "c", "tiles", F.pmod(F.xxhash64("h"), F.col("tiles")).alias("t"))
    met = tied.groupBy("h").agg(F.collect_list("bucket").alias("buckets"))  # one for each band at most
    apart = texts.join(cut.select("h").distinct(), "h", "left_semi").select("h", "k", "norm", _bits(_set(F.col("norm"), n)).alias("bits"))
    cut = cut.join(apart.join(met, "h"), "h")
    cut = cut.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("other"))
    cut = cut.select("bucket", F.least("t", "other").alias("i"), F.greatest("t", "other").alias("j"), F.struct("h", "c", "t", "k", "norm", "buckets", "bits").alias("x"))
    cells = mixed.agg(F.coalesce(F.sum(F.ceil(F.col("n") / tile) * (F.ceil(F.col("n") / tile) + 1) / 2), F.lit(0))).first()[0]
    cut = cut.repartition(max(int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions")), ceil(cells / 16)), "bucket", "i", "j")  # groups are small, but their pairs are many
    group = cut.groupBy("bucket", "i", "j").agg(F.collect_list("x").alias("all"))

    def links(lines: Column) -> Column:
        def meets(a: Column, b: Column) -> Column:
            met = (a.h < b.h) & (a.c != b.c) & ((F.col("i") == F.col("j")) | (a.t != b.t))
            once = F.array_min(F.array_intersect(a.buckets, b.buckets)) == F.col("bucket")
            return met & _near_in_size(a.k, b.k, percent) & _may_be_alike(a, b, percent) & once & _alike(_set(a.norm, n), _set(b.norm, n), a.k, b.k, percent)

        return F.flatten(F.transform(lines, lambda a: F.transform(F.filter(lines, lambda b: meets(a, b)), lambda b: F.struct(a.h.alias("src"), b.h.alias("dst")))))

    # all in one expression, as rows made in between would each copy the whole group
    found = F.flatten(F.transform(F.array("all"), links))
    return group.select(F.explode(found).alias("link")).select("link.src", "link.dst")


def line_components(lines: DataFrame, n: int = 8, percent: int = 80, parts: int = 3, tile: int = 256, broadcast_rows: int = 1_000_000) -> DataFrame:
    """``(node, component)`` of the distinct lines ``(h, norm)`` that near copies tie together."""
    tied = materialize(_tied(_buckets(lines, n, parts)), "ties")
    wanted = materialize(tied.select("h").distinct(), "tied")
    texts = lines.join(broadcast_if_small(wanted, broadcast_rows), "h", "left_semi").groupBy("h").agg(F.first("norm").alias("norm"))
    texts = materialize(texts.select("h", "norm", F.size(F.array_distinct(_set(F.col("norm"), n))).alias("k")), "texts")
    near = components(_verified(_chained(tied), texts, n, percent))
    more = materialize(_apart(tied, near, texts, n, percent, tile), "links")
    if more.isEmpty():
        return near
    return components(near.select(F.col("node").alias("src"), F.col("component").alias("dst")).union(more))


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``(key, drop)``: for every document that loses lines, their places; ``key`` is ``xxhash64(id, text)``.

    Of each component of lines the occurrence of the smallest (id, key, place) stays.
    """
    lines = _lines(docs, id_col, text_col)
    near = line_components(lines.select("h", "norm"), **options)
    found = lines.select("key", "id", "pos", "h").join(near.withColumnRenamed("node", "h"), "h", "left")
    found = found.select("key", "id", "pos", F.coalesce("component", "h").alias("component"))
    at = F.struct("id", "key", "pos")
    first = found.groupBy("component").agg(F.min(at).alias("stays"), F.count("*").alias("times")).where("times > 1")
    lost = found.join(first, "component").where(~at.eqNullSafe(F.col("stays")))
    return lost.groupBy("key").agg(F.collect_set("pos").alias("drop"))


def _cleaned(docs: DataFrame, id_col: str, text_col: str, broadcast_rows: int = 500_000, **options) -> DataFrame:
    """``(row, clean, lost)``: every row of ``docs``, its text without near-duplicate lines, and their number."""
    drops = materialize(dropped_lines(docs, id_col, text_col, **options), "drops")
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    rows = rows.withColumn("key", F.xxhash64(F.col("row").getField(id_col), F.col("row").getField(text_col).cast("string")))
    joined = rows.join(broadcast_if_small(drops, broadcast_rows), "key", "left")
    text = F.col("row").getField(text_col).cast("string")
    kept = F.filter(F.split(text, "\n", -1), lambda _, i: ~F.array_contains("drop", i))
    clean = F.when(F.col("drop").isNull(), text).otherwise(F.array_join(kept, "\n"))
    return joined.select("row", clean.alias("clean"), F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("lost"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", emptied: bool = True, **options) -> DataFrame:
    """The rows of ``docs`` with all columns, their near-duplicate lines taken out of ``text_col``.

    Lines are split at line feeds and compared lower-cased and trimmed, by the Jaccard
    similarity of their ``n``-character shingles, at least ``percent`` / 100.  One line per
    component stays: the occurrence of the smallest id, then place.  Blank lines stay.
    Null and empty texts stay as they are, so do other columns; texts and lines of any length are compared whole.  Rows repeated with id and
    text are one document: each such row gets the same text.  An empty table gives an
    empty one.  Without ``emptied``, rows that lost lines and have no words left go.
    """
    got = _cleaned(docs, id_col, text_col, **options)
    if not emptied:
        got = got.where("lost = 0 or clean rlike '\\\\S'")
    return got.select(*(F.col("clean").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row: id, ``n_kept`` lines, ``n_dropped`` lines and the text that stays; see :func:`dedup_lines` for ties, nulls and long texts."""
    got = _cleaned(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text", **options)
    kept = F.when(F.col("clean").isNotNull(), F.size(F.split("clean", "\n", -1))).otherwise(0).cast("long")
    return got.select(F.col("row.id").alias(id_col), kept.alias("n_kept"), F.col("lost").alias("n_dropped"), F.col("clean").alias("text"))

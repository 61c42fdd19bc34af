"""Exact dedup as a stateful stream, in DataFrame and Structured Streaming functions only.

The files of a table are a stream.  Its state, kept on the executors' disks by RocksDB and
in the checkpoint, has one entry for each digest and never expires: the stable identifier of
the row that stays, the locator of its content (file and row in it) and the number of rows
met.  Files that arrive later meet the same state, so only they are read.  A row's text
never enters the state or the shuffle that feeds it: equal digests meet as one partial
aggregate of each task.

A digest met again is a hit, and no proof.  The texts of all rows that hit are compared byte by
byte with the content that the locator names.  Rows that differ from it share a digest with
other texts; these digests alone are then grouped by their full texts.
"""

from __future__ import annotations

import contextlib
import string
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import broadcast_if_small, materialize, shared_dir

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: State on disk, changes alone written for each batch, one bound for the memory of all stores of an
#: executor, and a store closed as soon as its task has committed: thousands of partitions hold no memory then.
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": _PROVIDER,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "16",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


def normalised(text: Column) -> Column:
    """What is compared: A-Z lower-cased, nothing else changed; null counts as empty."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _rows(files: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    """``(digest, at, text)`` of every row; ``at`` orders rows by id, then file and place in it."""
    at = F.struct(F.col(f"`{id_col}`").alias("id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    rows = files.select(at.alias("at"), normalised(F.col(f"`{text_col}`")).alias("text"))
    return rows.select(digest(F.col("text")).alias("digest"), "at", "text")


@contextlib.contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Session settings that a stream copies when it starts; the caller's come back after that."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def ingest(
    spark: SparkSession,
    path: str,
    schema: StructType,
    folder: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256,
    batch_bytes: int = 1 << 36,
) -> DataFrame:
    """Run the stream over the files at ``path`` that ``folder`` has not seen; ``(digest, stays, size)`` of all seen.

    ``folder`` keeps the stream's checkpoint with the state, and what each batch has changed.
    A batch that is run again after a failure overwrites its own part.  ``path`` is a file, a
    folder or a pattern; batches take about ``batch_bytes`` of new files each.
    """
    # a pattern, as a stream refuses a path that is one file
    stream = spark.readStream.schema(schema).option("maxBytesPerTrigger", str(batch_bytes)).parquet(f"{path[:-1]}[{path[-1]}]")
    groups = _rows(stream, id_col, text_col, digest).groupBy("digest").agg(F.max("at").alias("stays"), F.count("*").alias("size"))

    def changed(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/changed/batch={number}")

    with _settings(spark, _STATE):
        query = groups.writeStream.outputMode("update").foreachBatch(changed).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    try:
        seen = spark.read.schema(StructType([*groups.schema.fields])).parquet(f"{folder}/changed")
    except Exception as e:  # no file yet: nothing was ever written
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], groups.schema)
    return seen.groupBy("digest").agg(F.max("stays").alias("stays"), F.max("size").alias("size"))  # both only grow


def _unlike(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """Digests of ``hits`` under which some row's text differs from the content that the locator names."""
    met = rows.join(hits, "digest")
    content = met.where(F.col("at").eqNullSafe(F.col("stays"))).select("digest", F.col("text").alias("content"))
    return met.where(~F.col("at").eqNullSafe(F.col("stays"))).select("digest", "text").join(content, "digest").where("text != content").select("digest").distinct()


def duplicates(
    spark: SparkSession,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    folder: str | None = None,
    digest: Callable[[Column], Column] = sha256,
    broadcast_rows: int = 200_000,
    **options,
) -> DataFrame:
    """Per row of the Parquet files at ``path``: ``id, keep_id, group_size, kept, file, row, text_sha256``.

    Texts are equal when they are so after lower-casing A-Z; null counts as empty.  Of equal
    texts the row of the largest id stays; of rows with that id too, the one of the last file,
    then place, so repeated rows count in ``group_size`` and exactly one of a group is ``kept``.
    A null id is the smallest of all.  Texts of any length count whole; an empty table gives an
    empty one; other columns, whatever their names, are not read.  ``folder`` is where state is
    kept from one call to the next: give it to read only files that are new (rows that stayed
    may be dropped later, when an equal text with a larger id arrives).  Files must not change
    once they are there.
    """
    table = spark.read.parquet(path)
    folder = folder or f"{shared_dir(spark)}/exact-{uuid.uuid4().hex}"
    groups = materialize(ingest(spark, path, table.schema, folder, id_col, text_col, digest, **options), "groups")
    rows = _rows(table, id_col, text_col, digest)
    hits = groups.where("size > 1")
    unlike = materialize(_unlike(rows, broadcast_if_small(hits, broadcast_rows)), "unlike")
    found = rows.select("digest", "at", sha256(F.col("text")).alias("text_sha256"))
    grouped = found.join(hits, "digest", "left")
    if not unlike.isEmpty():
        mixed = rows.join(unlike, "digest", "left_semi")
        whole = mixed.groupBy("digest", "text").agg(F.max("at").alias("stays"), F.count("*").alias("size"))
        told = mixed.join(whole, ["digest", "text"]).select("digest", "at", sha256(F.col("text")).alias("text_sha256"), "stays", "size")
        grouped = grouped.join(unlike, "digest", "left_anti").unionByName(told)
    stays = F.coalesce("stays", "at")
    return grouped.select(
        F.col("at.id").alias("id"),
        stays.getField("id").alias("keep_id"),
        F.coalesce("size", F.lit(1).cast("long")).alias("group_size"),
        F.col("at").eqNullSafe(stays).alias("kept"),
        F.col("at.file").alias("file"),
        F.col("at.row").alias("row"),
        "text_sha256",
    )


def report(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row: id, ``keep_id, group_size, kept, text_sha256``."""
    got = duplicates(spark, path, id_col, text_col, **options)
    return got.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", "text_sha256")


def sql() -> str:
    return f"""
        with texts as (select doc_id, translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') t from documents)
        select doc_id, max(doc_id) over w keep_id, count(*) over w group_size, doc_id = max(doc_id) over w kept, sha256(t) text_sha256
        from texts window w as (partition by t)"""

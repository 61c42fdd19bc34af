"""Helpers that the corpus operators share: shared storage, sizes and row keys."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and every executor can reach.

    The session's ``spark.checkpoint.dir`` names it on a cluster.  Only where that is
    unset (tests, local mode) a temporary folder is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="ledgerloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # noqa: BLE001  the session has ended; its folder goes with it
        pass


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it again.

    This cuts the lineage: a lost executor costs only the tasks that it ran, and a result
    used twice is computed once.  The folder goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_delete, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what :func:`materialize` wrote, once nothing reads it any more."""
    _delete(df.sparkSession, df._written)


def small(df: DataFrame, rows: int) -> bool:
    """True if ``df`` has at most ``rows`` rows; reads no more than that many."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint behind a check of the size; beyond it Spark's shuffle joins do the work."""
    return F.broadcast(df) if small(df, rows) else df


def signed(column):
    """uint64 array seen as int64, the type Spark stores."""
    return column.view("int64")


def small_batches(spark: SparkSession) -> None:
    """Let whole texts travel to Python by the 1,000, not the 10,000 rows that Spark sends unless told otherwise."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, "1000")


def release() -> None:
    """Give what a task has freed back to the machine: Python workers outlive their tasks."""
    from . import words

    words.forget()
    gc.collect()
    trim()


def trim() -> None:
    """Give back what is free already; takes about a millisecond."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # other C libraries have no such call
        pass


def freed(rows):
    """The rows of a task; when they end, what the task held goes back to the machine."""
    try:
        yield from rows
    finally:
        release()

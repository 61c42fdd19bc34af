"""Results that several steps of a plan read: written once to the folder that the cluster shares."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_DEALT = "dealt_to"


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder only where that is unset in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="ledgerloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def path_of(spark: SparkSession, path: str):
    """The path and its file system, as Hadoop has them."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def dealt(df: DataFrame, tasks: int | None, *by: str) -> DataFrame:
    """``df`` dealt out by columns, to ``tasks`` tasks or as many as the session says."""
    return df.repartition(tasks, *by) if tasks else df.repartition(*by)


def place(df: DataFrame, tasks: int) -> DataFrame:
    """``df`` dealt by ``tx`` alone to ``tasks`` tasks, which its column ``tx`` remembers; hashes are lower-case."""
    return df.withMetadata("tx", {_DEALT: tasks}).repartition(tasks, "tx")


def placed(df: DataFrame) -> int | None:
    """The tasks that rows were dealt to by :func:`place`, while their ``tx`` is still the one that they were dealt by."""
    return df.schema["tx"].metadata.get(_DEALT) if "tx" in df.columns else None


def met(rows: DataFrame, others: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``others`` by columns; those dealt alike by transaction meet where they are.

    Spark deals rows anew unless they lie by all keys of a join, so the transaction is the only
    key then, and the other columns are compared within it: a transaction is no larger than a block.
    """
    if not placed(rows) or placed(rows) != placed(others):
        return rows.join(others, on, how)
    others = others.withColumnsRenamed({c: f"_{c}" for c in on})
    same = [(F.col(c) >= F.col(f"_{c}")) & (F.col(c) <= F.col(f"_{c}")) for c in on if c != "tx"]
    got = rows.join(others, reduce(lambda a, b: a & b, same, F.col("tx") == F.col("_tx")), how)
    return got.drop(*(f"_{c}" for c in on))


def delete(spark: SparkSession, path: str) -> None:
    hadoop, files = path_of(spark, path)
    files.delete(hadoop, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet and read it again: its plan is run once, and lost tasks need nothing from before it.

    Rows that were dealt by transaction (:func:`place`) are a bucketed table, and stay dealt.
    """
    spark, buckets = df.sparkSession, placed(df)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    table = re.sub(r"\W", "_", path.rsplit("/", 1)[1])
    if buckets:
        df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, "tx").sortBy("tx").saveAsTable(table)
    else:
        df.write.option("compression", "zstd").parquet(path)

    def gone() -> None:
        with contextlib.suppress(Exception):  # the session has ended; its folder goes with it
            if buckets:
                spark.sql(f"DROP TABLE IF EXISTS {table}")
            delete(spark, path)

    atexit.register(gone)
    return spark.table(table) if buckets else spark.read.schema(df.schema).parquet(path)

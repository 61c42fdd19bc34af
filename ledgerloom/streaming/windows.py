"""Event streams: the same plans serve batch frames and Structured Streaming."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tumbling(events: DataFrame, size: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts and value by event type and window; on a stream, state older than ``late`` goes."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    got = timed.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("events"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("value"))
    return got.select(F.col("window.start").alias("start"), "event_type", "events", "value")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Per user the runs of events no further apart than ``gap``."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    got = timed.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("events"))
    return got.select("user_id", F.col("session_window.start").alias("start"), "events")


def first_seen(events: DataFrame, key: list[str], late: str = "1 day") -> DataFrame:
    """Each key once; on a stream within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(key) if events.isStreaming else events.dropDuplicates(key)


def append_batches(stream: DataFrame, path: str, key: list[str], checkpoint: str):
    """Exactly-once append: each micro-batch writes the rows whose key the table lacks."""

    def write(batch: DataFrame, _: int) -> None:
        spark: SparkSession = batch.sparkSession
        try:
            old = spark.read.schema(batch.schema).parquet(path).select(*key)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":  # only the first batch finds no table
                raise
            old = batch.select(*key).limit(0)
        batch.dropDuplicates(key).join(old, key, "left_anti").write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


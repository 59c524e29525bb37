"""Structured Streaming over events and notes. The same functions run on batch tables.

Windows with a watermark drop their state once it is passed; notes are upserted by content hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_stream(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def window_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """start, event_type, n, total of tumbling or sliding windows."""
    return _grouped(events, F.window("ts", width, slide) if slide else F.window("ts", width), late, "event_type")


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """start, user_id, n, total of each user's sessions."""
    return _grouped(events, F.session_window("ts", gap), late, "user_id")


def _grouped(events: DataFrame, window: Column, late: str, key: str) -> DataFrame:
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(window.alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def changed_notes(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Incoming notes (path, text) whose content the stored ones (path, hash) don't have."""
    return incoming.withColumn("hash", F.sha2("text", 256)).join(stored.select("path", "hash"), ["path", "hash"], "left_anti")


def upsert_notes(stream: DataFrame, folder: str, checkpoint: str):
    """Append each batch's changed notes as new versions; :func:`latest` reads the last of each path."""

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        once = batch.groupBy("path").agg(F.max_by("text", F.xxhash64("text")).alias("text"))
        hashed = once.withColumn("hash", F.sha2("text", 256))
        try:
            hashed = changed_notes(once, latest(spark.read.parquet(folder)))
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        hashed.withColumn("version", F.lit(number).cast("bigint")).write.mode("append").parquet(folder)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)


def latest(versions: DataFrame) -> DataFrame:
    return versions.groupBy("path").agg(F.max_by(F.struct("text", "hash", "version"), "version").alias("v")).select("path", "v.*")

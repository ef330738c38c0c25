"""Streaming counterparts: windowed counts, sessions, deduplication and an upsert sink."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes", ts: str = "ts", kind: str = "event_type") -> DataFrame:
    """(start, kind, n, total) per tumbling or sliding window; works on a stream and on a table alike."""
    stamped = events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    window = F.window("__ts", width, slide) if slide else F.window("__ts", width)
    return stamped.groupBy(window.alias("w"), kind).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), kind, "n", "total")


def sessions(events: DataFrame, gap: str = "4 hours", late: str = "10 minutes", ts: str = "ts", entity: str = "user_id") -> DataFrame:
    """(entity, start, end, n): runs of events whose gaps do not exceed ``gap``."""
    stamped = events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    grouped = stamped.groupBy(F.session_window("__ts", gap).alias("w"), entity).agg(F.count("*").alias("n"), F.min("__ts").alias("start"), F.max("__ts").alias("end"))
    return grouped.select(entity, "start", "end", "n")


def deduplicated(events: DataFrame, key: str, late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    return events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late).dropDuplicatesWithinWatermark([key]).drop("__ts")


def upsert_sink(path: str, key: str, merge: Callable[[DataFrame, DataFrame, str], DataFrame], replace: Callable[[DataFrame, str], None]) -> Callable:
    """For ``foreachBatch``: merges each batch into the table at ``path``."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        delta = batch.dropDuplicates([key])
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            delta.write.parquet(path)
            return
        replace(merge(spark.read.parquet(path), delta, key), path)

    return write

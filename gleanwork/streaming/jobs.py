"""Streams: the batch operators over files as they land."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.gates import split_rejects


def landing(spark: SparkSession, path: str, schema: str, files_at_once: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def normalized(stream: DataFrame, normalize: Callable[[DataFrame], DataFrame], reason: Column) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with ``reject_reason``) of a landed stream: the batch rules on the rows as they come."""
    return split_rejects(normalize(stream), reason)


def once_by_id(stream: DataFrame, key: str, time: str, within: str) -> DataFrame:
    """The first row of each id inside the watermark; state older than that is dropped."""
    return stream.withWatermark(time, within).dropDuplicatesWithinWatermark([key])


def category_counts(stream: DataFrame, category: Column, time: str, late: str = "1 hour", width: str = "24 hours", slide: str | None = None) -> DataFrame:
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return stream.withWatermark(time, late).groupBy(w.alias("w"), category.alias("category")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "category", "n")


def inactivity_groups(stream: DataFrame, key: str, time: str, gap: str = "36 hours", late: str = "1 hour") -> DataFrame:
    grouped = stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("s"), key).agg(F.count("*").alias("items"))
    return grouped.select(key, F.col("s.start").alias("first_seen"), "items")


def fresh(stream: DataFrame, time: str, as_of: Column, minutes: int = 180) -> DataFrame:
    return stream.filter(F.col(time).isNull() | (F.col(time) >= as_of - F.expr(f"interval {minutes} minutes")))


def upsert_batches(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run ``apply`` once for each micro-batch of what has landed, then stop."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drained(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream to the end of what has landed and read its result."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)

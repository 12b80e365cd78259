"""Structured Streaming over event tables: an extension for live inputs, with the batch operators' aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_events(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_totals(events: DataFrame, late: str = "1 day", width: str = "1 day") -> DataFrame:
    """Counts and sums per window and type; events later than the watermark are dropped by the engine. Works on batches too."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    source = timed.withWatermark("ts", late) if timed.isStreaming else timed
    return source.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    source = timed.withWatermark("ts", late) if timed.isStreaming else timed
    return source.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")

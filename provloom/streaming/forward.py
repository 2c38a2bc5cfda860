"""Forward ingestion as a stream: 30-minute tumbling counts and dedup of events within the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling_counts(stream: DataFrame, width: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).groupBy(F.window("at", width), "event_type").count().select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "count")


def deduplicated(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    return stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"])

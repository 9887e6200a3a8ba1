"""Structured Streaming over landed data: sources parsed as they arrive, and running counts of flows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import ingest
from ..sources import languages as L


def parsed_arrivals(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of parse facts (table, path, seq, payload) for files that land in a folder."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(folder)
    dims = F.broadcast(L.extension_table(spark).select("language", "extension"))
    keyed = raw.withColumn("extension", F.lower(F.regexp_extract("path", r"(\.[^./\\]+)$", 1))).join(dims, "extension")
    return ingest.parsed(keyed.select("path", "language", "content"))


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts and sums of events by type and window; works on a stream (rows later than ``late`` are left out) and on a table."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    out = timed.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users") if not events.isStreaming else F.approx_count_distinct("user_id").alias("users"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "users")

"""The index log as a stream: new lines become the store's latest state, and spend is kept by window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poolstat.sources.store import INDEX


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    """JSONL files of a folder as they come; `storedAt` also as a timestamp."""
    return spark.readStream.schema(INDEX).json(folder).withColumn("stored_at", F.to_timestamp("storedAt"))


def first_of_key(log: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark: appends are idempotent, so a repeat is the same record."""
    return log.withWatermark("stored_at", late).dropDuplicatesWithinWatermark(["key"])


def states_by_window(log: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    return log.withWatermark("stored_at", late).groupBy(F.window("stored_at", width), "state").agg(F.count("*").alias("n"))


def append_to(folder: str, checkpoint: str):
    """A writer that appends deduplicated records to Parquet, exactly once by its checkpoint."""
    return lambda log: log.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append")

"""Streams of the audit log: an extension, as the model has no streams of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream(spark: SparkSession, path: str, schema: str, files_at_once: int = 1) -> DataFrame:
    """The rows of parquet files of a folder as they appear."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def windows(runs: DataFrame, time: str, kind: str, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """Rows by window and kind; those later than `late` are dropped, and a window is kept until then."""
    timed = runs.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", late)
    counts = timed.groupBy(F.window("_at", size), kind).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("start"), kind, "n")


def sessions(runs: DataFrame, time: str, user: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user: start, end and rows; a session ends after a gap."""
    timed = runs.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", late)
    counts = timed.groupBy(F.session_window("_at", gap), user).agg(F.count("*").alias("n"))
    return counts.select(user, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def once(runs: DataFrame, key: str, time: str, late: str = "1 hour") -> DataFrame:
    """Each run once, as an upsert by its id does; ids are remembered until the watermark passes."""
    return runs.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", late).dropDuplicatesWithinWatermark([key]).drop("_at")

"""Streaming ingest: first-seen papers and windowed counts; an extension, the batch engine does not need it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def first_seen(stream: DataFrame, key: str, ts: str, delay: str = "10 minutes") -> DataFrame:
    """Rows whose key was not seen within the watermark; state is bounded by it."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, ts: str, by: str, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    out = stream.withWatermark(ts, delay).groupBy(F.window(ts, window), by).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("window.start").alias("start"), by, "n")


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Take what is there, write it as Parquet exactly once, and stop."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def read_stream(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame:
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", 16).parquet(folder)

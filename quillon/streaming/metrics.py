"""Metric snapshots as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream over the Parquet files that are added to a folder."""
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed(stream: DataFrame, width: str = "1 day", late: str = "7 days") -> DataFrame:
    """Count and mean per repository, metric and window; repeated snapshots count once, rows later than the watermark are left out."""
    once = stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["repo_id", "metric", "ts", "value"])
    return once.groupBy(F.window("ts", width).alias("w"), "repo_id", "metric").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value")).select(F.col("w.start").alias("start"), "repo_id", "metric", "n", "mean_value")


def write(stream: DataFrame, folder: str, checkpoint: str):
    """Appends closed windows; restarts go on from the checkpoint."""
    return stream.writeStream.outputMode("append").format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

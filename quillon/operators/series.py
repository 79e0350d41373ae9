"""Metric snapshots over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def clean(metrics: DataFrame) -> DataFrame:
    """One value per repository, metric and time: the one loaded last (then the larger)."""
    return metrics.groupBy("repo_id", "metric", "ts").agg(F.max_by("value", F.struct("loaded_at", "value")).alias("value"))


def changes(metrics: DataFrame) -> DataFrame:
    """Every snapshot with the change in percent from the one before; none without a previous value or from 0."""
    order = Window.partitionBy("repo_id", "metric").orderBy("ts")
    out = clean(metrics).where("value is not null").withColumn("previous", F.lag("value").over(order))
    change = F.when(F.col("previous") != 0, (F.col("value") - F.col("previous")) / F.abs("previous") * 100)
    return out.withColumn("change_pct", F.round(change, 4))


def latest_changes(metrics: DataFrame) -> DataFrame:
    """The change between the last two snapshots of each metric."""
    order = Window.partitionBy("repo_id", "metric").orderBy(F.desc("ts"))
    return changes(metrics).withColumn("r", F.row_number().over(order)).where("r = 1 and change_pct is not null").drop("r")


def daily(metrics: DataFrame) -> DataFrame:
    return clean(metrics).groupBy("repo_id", "metric", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))

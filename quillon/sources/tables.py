"""Named tables stored as Parquet under one directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan of one table; filters and column selection reach the Parquet reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

"""Queries of problem 3."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import encoding
from quillon.sources.tables import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding.found(table(spark, d, "source_files"))


def p3_restored(spark: SparkSession, d: str) -> DataFrame:
    """Garbled rows with their repaired text."""
    rows = table(spark, d, "source_files").select("file_id", "raw_content").where(F.col("raw_content").rlike(encoding.NON_ASCII))
    return encoding.repair(rows).where("garbled").drop("raw_content")


QUERIES = {"p3_found": p3_found, "p3_restored": p3_restored}
ORACLES: dict[str, str] = {}

"""Queries of problem 6."""

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import secrets
from quillon.sources.tables import table


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return secrets.find(table(spark, d, "source_files"))


def p6_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Rows with credentials and their masked text."""
    return secrets.redact(table(spark, d, "source_files"))


QUERIES = {"p6_found": p6_found, "p6_redacted": p6_redacted}
ORACLES: dict[str, str] = {}

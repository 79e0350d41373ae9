"""Queries of problem 5."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import licenses
from quillon.sources.tables import table


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return licenses.resolve(table(spark, d, "source_files"), table(spark, d, "repos"), table(spark, d, "license_refs"))


def p5_rates(spark: SparkSession, d: str) -> DataFrame:
    """How many repositories and files each result has."""
    return p5_found(spark, d).groupBy("scope", "license").agg(F.count("*").alias("n"))


QUERIES = {"p5_found": p5_found, "p5_rates": p5_rates}
ORACLES: dict[str, str] = {}

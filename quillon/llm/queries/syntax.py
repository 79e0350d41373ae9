"""Queries of problem 4."""

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import syntax
from quillon.sources.tables import table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return syntax.found(table(spark, d, "source_files"))


def p4_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax.rates(syntax.check(table(spark, d, "source_files")))


QUERIES = {"p4_found": p4_found, "p4_rates": p4_rates}
ORACLES: dict[str, str] = {}

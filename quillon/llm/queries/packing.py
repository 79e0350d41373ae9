"""Queries of problem 8."""

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import packing, tokens
from quillon.sources.tables import table


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    sized = tokens.with_sizes(table(spark, d, "documents"))
    return packing.pack(sized, table(spark, d, "capacity_classes"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(p8_containers(spark, d))


QUERIES = {"p8_containers": p8_containers, "p8_fill": p8_fill}
ORACLES: dict[str, str] = {}

"""Queries of problem 10."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import toxicity
from quillon.sources.tables import table


def _scored(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return toxicity.score(documents, toxicity.fit(documents, table(spark, d, "labels")))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).where(F.col("score") >= toxicity.THRESHOLD).select("doc_id").distinct()


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.rates(_scored(spark, d))


QUERIES = {"p10_found": p10_found, "p10_rates": p10_rates}
ORACLES: dict[str, str] = {}

"""Queries of problem 2."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import provenance
from quillon.sources.tables import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return provenance.found(table(spark, d, "source_files"))


def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    """Files, cases and their share per repository."""
    files = table(spark, d, "source_files")
    verdicts = provenance.classify(files).select("file_id", "is_case", "score")
    joined = files.select("file_id", "repo_id").join(verdicts, "file_id")
    return joined.groupBy("repo_id").agg(F.count("*").alias("n_files"), F.count_if("is_case").alias("n_cases"), F.round(F.avg(F.col("is_case").cast("int")), 6).alias("share"))


QUERIES = {"p2_found": p2_found, "p2_rates": p2_rates}
ORACLES: dict[str, str] = {}

"""Queries of problem 9."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import mixing, tokens
from quillon.sources.tables import table


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    sized = tokens.with_sizes(table(spark, d, "documents"), keep=("source",))
    return mixing.mix(sized, table(spark, d, "mix_targets"), table(spark, d, "labels"))


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.report(p9_mix(spark, d), table(spark, d, "mix_targets"))


def p9_capped(spark: SparkSession, d: str) -> DataFrame:
    """The report of mixes as large as all documents together, where caps on repeats bind and shares fall short."""
    sized = tokens.with_sizes(table(spark, d, "documents"), keep=("source",))
    targets = table(spark, d, "mix_targets")
    total = sized.agg(F.sum("n_tokens")).first()[0] or 0
    return mixing.report(mixing.mix(sized, targets, table(spark, d, "labels"), total_tokens=total), targets)


QUERIES = {"p9_mix": p9_mix, "p9_report": p9_report, "p9_capped": p9_capped}
ORACLES: dict[str, str] = {}

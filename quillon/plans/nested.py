"""Queries of problem 1: nested records to flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import shred
from quillon.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return shred.links(shred.shred(table(spark, d, "cortex_raw"), labels=shred.KEY_LABELS))


def _entity(kind: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return shred.entity_table(shred.stored(table(spark, d, "cortex_raw")), kind)

    return run


def p1_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Node counts per depth and kind over all payloads."""
    nodes = shred.shred(table(spark, d, "cortex_raw"))
    return nodes.groupBy("depth", "kind").agg(F.count("*").alias("n_nodes"), F.countDistinct("record_id").alias("n_records"))


QUERIES = {
    "p1_found": p1_found,
    "p1_files": _entity("file"),
    "p1_chunks": _entity("chunk"),
    "p1_endpoints": _entity("endpoint"),
    "p1_dependencies": _entity("dependency"),
    "p1_services": _entity("service"),
    "p1_nodes": p1_nodes,
}
ORACLES: dict[str, str] = {}

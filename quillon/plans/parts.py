"""Queries on parts of summaries: kinds of imports, coupling, categories of dependencies, suffixes, contexts with clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import paths
from quillon.functions.text import line_count
from quillon.operators import diffs, graph, retrieval, supply
from quillon.plans.files import _EXT, _LANG, _LINES
from quillon.plans.graphs import _E, _edges
from quillon.plans.search import _HITS, _hits
from quillon.sources.tables import table


def import_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Relative and absolute imports of Python files, per repository."""
    f = table(spark, d, "source_files").where(paths.language(F.col("file_path")) == "python")
    count = lambda p: F.sum(F.regexp_count(F.coalesce("raw_content", F.lit("")), F.lit(p))).cast("bigint")
    return f.groupBy("repo_id").agg(count(_RELATIVE).alias("n_relative"), count(_ABSOLUTE).alias("n_absolute"))


def graph_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Nodes, edges and their ratio (coupling) of every repository's graph."""
    e = graph.collapse(_edges(spark, d))
    ends = e.select("repo_id", F.col("source").alias("node")).unionByName(e.select("repo_id", F.col("target").alias("node"))).distinct().groupBy("repo_id").agg(F.count("*").alias("n_nodes"))
    return e.groupBy("repo_id").agg(F.count("*").alias("n_edges")).join(ends, "repo_id").select("repo_id", "n_nodes", "n_edges", F.round(F.col("n_edges") / F.col("n_nodes"), 6).alias("coupling"))


def bom_summary(spark: SparkSession, d: str) -> DataFrame:
    """Dependencies by category, and the language with most lines, of every repository with dependencies."""
    deps = supply.clean(table(spark, d, "dependencies")).groupBy("repo_id").agg(F.count("*").alias("total"), *[F.count_if(F.col("dependency_type") == k).alias(k) for k in ("application", "development", "testing")])
    f = table(spark, d, "source_files").withColumn("language", paths.language(F.col("file_path"))).where("language <> 'unknown'")
    lines = f.groupBy("repo_id", "language").agg(F.sum(line_count(F.col("raw_content"))).alias("n"))
    best = lines.groupBy("repo_id").agg(F.min_by("language", F.struct((-F.col("n")).alias("m"), "language")).alias("primary_language"))
    return deps.join(best, "repo_id", "left")


def suffix_counts(spark: SparkSession, d: str) -> DataFrame:
    """Files by suffix and top directory of every repository."""
    f = table(spark, d, "source_files").where("file_path is not null")
    top = F.when(F.col("file_path").contains("/"), F.split("file_path", "/")[0]).otherwise("")
    return f.groupBy("repo_id", top.alias("top"), paths.suffix(F.col("file_path")).alias("ext")).agg(F.count("*").alias("n"))


def span_problems(spark: SparkSession, d: str) -> DataFrame:
    """chunks whose place is missing or runs backwards, by kind of problem; :func:`diffs.checked_spans` stops at them instead."""
    return diffs.span_problems(table(spark, d, "chunks").select("chunk_id", "file_path", "start_line", "end_line").distinct()).groupBy("problem").agg(F.count("*").alias("n"))


def hop_summary(spark: SparkSession, d: str) -> DataFrame:
    """How many hits each file and each cluster of a query's context holds, five clusters at most."""
    hits = retrieval.select_hits(_hits(spark, d), 20)
    return hits.groupBy("query_id").agg(F.count("*").alias("n_hits"), F.countDistinct("path").alias("n_files"), F.least(F.countDistinct("cluster"), F.lit(5)).alias("n_clusters"))


def best_per_file(spark: SparkSession, d: str) -> DataFrame:
    """Files of a query's hits in order of their best one, with the five best hits of each."""
    hits = _hits(spark, d)
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy("query_id", "path").orderBy(F.desc("score"), "id"))
    per = hits.withColumn("at", at).where("at <= 5").groupBy("query_id", "path").agg(F.max("score").alias("best"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.col("id").cast("string").alias("id")))), lambda s: s["id"]), " ").alias("ids"))
    return per.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("best"), "path")).cast("bigint")).drop("best")


QUERIES = {f.__name__: f for f in (import_kinds, graph_metrics, bom_summary, suffix_counts, span_problems, hop_summary, best_per_file)}

_COUNT = lambda p: f"CAST(sum(len(regexp_extract_all(coalesce(raw_content, ''), '{p}'))) AS BIGINT)"
_RELATIVE, _ABSOLUTE = r"(?m)^\s*from\s+\.", r"(?m)^\s*(?:from\s+[a-zA-Z_]|import\s+[a-zA-Z_])"
ORACLES = {
    "import_kinds": f"SELECT repo_id, {_COUNT(_RELATIVE)} AS n_relative, {_COUNT(_ABSOLUTE)} AS n_absolute FROM source_files WHERE {_LANG} = 'python' GROUP BY 1",
    "graph_metrics": f"WITH {_E}, x AS (SELECT repo_id, source AS node FROM e UNION SELECT repo_id, target FROM e), y AS (SELECT repo_id, count(*) AS n_nodes FROM x GROUP BY 1), z AS (SELECT repo_id, count(*) AS n_edges FROM (SELECT DISTINCT repo_id, source, target FROM e) GROUP BY 1) SELECT repo_id, n_nodes, n_edges, round(n_edges / n_nodes, 6) AS coupling FROM y JOIN z USING (repo_id)",
    "bom_summary": f"WITH d AS (SELECT DISTINCT repo_id, name, version, dependency_type, ecosystem, license, deprecated FROM dependencies), t AS (SELECT repo_id, count(*) AS total, CAST(count_if(dependency_type = 'application') AS BIGINT) AS application, CAST(count_if(dependency_type = 'development') AS BIGINT) AS development, CAST(count_if(dependency_type = 'testing') AS BIGINT) AS testing FROM d GROUP BY 1), l AS (SELECT repo_id, {_LANG} AS language, sum({_LINES}) AS n FROM source_files GROUP BY 1, 2 HAVING language <> 'unknown'), b AS (SELECT repo_id, language AS primary_language FROM l QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY n DESC, language) = 1) SELECT t.*, primary_language FROM t LEFT JOIN b ON b.repo_id = t.repo_id",
    "suffix_counts": f"SELECT repo_id, CASE WHEN contains(file_path, '/') THEN split_part(file_path, '/', 1) ELSE '' END AS top, {_EXT} AS ext, count(*) AS n FROM source_files WHERE file_path IS NOT NULL GROUP BY 1, 2, 3",
    "span_problems": "WITH c AS (SELECT DISTINCT chunk_id, file_path, start_line, end_line FROM chunks) SELECT CASE WHEN start_line IS NULL OR end_line IS NULL THEN 'missing' WHEN start_line > end_line THEN 'backwards' END AS problem, count(*) AS n FROM c WHERE problem IS NOT NULL GROUP BY 1",
    "best_per_file": f"WITH {_HITS}, t AS (SELECT query_id, path, max(score) AS best, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY score DESC, id) AS ids FROM (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY query_id, path ORDER BY score DESC, id) <= 5) GROUP BY 1, 2) SELECT query_id, path, ids, row_number() OVER (PARTITION BY query_id ORDER BY best DESC, path) AS place FROM t",
}

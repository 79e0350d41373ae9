"""Operators composed of others: spans per file, expert per step, handlers and their calls, locus of a change, issue ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import paths
from quillon.functions.text import line_count
from quillon.operators import expertise, graph


def span_map(chunks: DataFrame) -> DataFrame:
    """(file_id, n_spans, first_line, last_line) of the chunks whose lines are known; repeated chunks count once."""
    known = chunks.where("start_line is not null and end_line is not null").select("file_id", "chunk_id", "start_line", "end_line").distinct()
    return known.groupBy("file_id").agg(F.count("*").alias("n_spans"), F.min("start_line").alias("first_line"), F.max("end_line").alias("last_line"))


def graph_context(edges: DataFrame, nodes: DataFrame, first: int = 5) -> DataFrame:
    """(repo_id, n_nodes, n_edges, sample): counts and the first node names.

    The first names are taken in two steps, of buckets of nodes and then of a repository, so no task sorts all nodes of a hot one.
    """
    e = graph.collapse(edges).groupBy("repo_id").agg(F.count("*").alias("n_edges"))
    bucketed = nodes.select("repo_id", "node_id").distinct().withColumn("b", F.pmod(F.xxhash64("node_id"), F.lit(256)))
    per = bucketed.groupBy("repo_id", "b").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_list("node_id")), 1, first).alias("some"))
    n = per.groupBy("repo_id").agg(F.sum("n").alias("n_nodes"), F.array_join(F.slice(F.array_sort(F.flatten(F.collect_list("some"))), 1, first), ", ").alias("sample"))
    return n.join(e, "repo_id", "left").select("repo_id", "n_nodes", F.coalesce("n_edges", F.lit(0)).alias("n_edges"), "sample")


def steps_with_experts(steps: DataFrame, blame: DataFrame) -> DataFrame:
    """Left join of learning steps (repo_id, node, level) with the leading author of the file."""
    top = expertise.file_experts(blame, 1).select("repo_id", F.col("file_path").alias("node"), "email", "score")
    return steps.join(top, ["repo_id", "node"], "left")


def handler_targets(endpoints: DataFrame, files: DataFrame, edges: DataFrame) -> DataFrame:
    """(file_id, handler, path, n_targets): what the file of each endpoint's handler leads to; none gives 0."""
    e = graph.collapse(edges).groupBy("repo_id", F.col("source").alias("file_path")).agg(F.count("*").alias("n_targets"))
    at = files.select("file_id", "repo_id", "file_path")
    return endpoints.select("file_id", "handler", "path").join(at, "file_id").join(e, ["repo_id", "file_path"], "left").select("file_id", "handler", "path", F.coalesce("n_targets", F.lit(0)).alias("n_targets"))


def locus(hits: DataFrame, files_of: DataFrame, most: int = 3) -> DataFrame:
    """(query_id, path, place): the first distinct files among a query's hits, by rank."""
    first = hits.join(files_of, "id").groupBy("query_id", "path").agg(F.min("rank").alias("best"))
    order = Window.partitionBy("query_id").orderBy("best", "path")
    return first.withColumn("place", F.row_number().over(order).cast("bigint")).where(F.col("place") <= most).drop("best")


def ranked_issues(scores: DataFrame, issues: DataFrame) -> DataFrame:
    """Inner join by number, highest score first; issues without a score are left out, ties go by number."""
    joined = issues.join(scores.withColumnRenamed("issue_number", "number"), "number")
    # Scores are few and issues many: an offset per score and a rank within it need no sort of all rows in one task.
    counts = joined.groupBy("score").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    within = joined.withColumn("at", F.row_number().over(Window.partitionBy("score").orderBy("number")))
    return within.join(before, "score").withColumn("rank", (F.col("before") + F.col("at")).cast("bigint")).drop("before", "at")


def plan_files(plan: DataFrame, files: DataFrame) -> DataFrame:
    """Left join of planned paths with contents; a path that does not exist yet has an empty text."""
    texts = files.groupBy("repo_id", "file_path").agg(F.max_by("raw_content", "file_id").alias("raw_content"))
    return plan.join(texts, ["repo_id", "file_path"], "left").withColumn("raw_content", F.coalesce("raw_content", F.lit("")))


def complexity(files: DataFrame) -> DataFrame:
    """(repo_id, language, n_files, n_lines, mean_lines, largest): size per language."""
    n = line_count(F.col("raw_content")).cast("bigint")
    return files.groupBy("repo_id", paths.language(F.col("file_path")).alias("language")).agg(F.count("*").alias("n_files"), F.sum(n).alias("n_lines"), F.round(F.avg(n), 4).alias("mean_lines"), F.max(n).alias("largest"))


#: Configuration files by name and what they configure.
CONFIG_FILES = {
    "package.json": "npm", "tsconfig.json": "typescript", "pyproject.toml": "python", "setup.cfg": "python", "Cargo.toml": "rust", "go.mod": "go", "pom.xml": "maven", "Dockerfile": "docker", "docker-compose.yml": "docker", ".env": "environment", "Makefile": "make",
}


def config_files(files: DataFrame) -> DataFrame:
    """(repo_id, file_path, kind) of known configuration files."""
    kind = paths.lit_map(CONFIG_FILES)[paths.basename(F.col("file_path"))]
    return files.select("repo_id", "file_path", kind.alias("kind")).where("kind is not null").distinct()


def warnings(files: DataFrame, most_mb: float = 50.0) -> DataFrame:
    """(repo_id, warning): no readme, no tests, no license, or files above a size."""
    p = F.lower("file_path")
    agg = files.groupBy("repo_id").agg(F.bool_or(p.rlike("(^|/)readme")).alias("r"), F.bool_or(p.contains("test")).alias("t"), F.bool_or(p.rlike("(^|/)(licen[cs]e|copying)")).alias("l"), F.bool_or(F.col("file_size_kb") > most_mb * 1024).alias("b"))
    found = F.array_compact(F.array(F.when(~F.col("r"), "no_readme"), F.when(~F.col("t"), "no_tests"), F.when(~F.col("l"), "no_license"), F.when(F.col("b"), "large_files")))
    return agg.select("repo_id", F.explode(found).alias("warning"))

"""Queries composed of several operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import chunking, compose, edits, graph, retrieval
from quillon.plans.graphs import linked_seeds
from quillon.session import cut_lineage
from quillon.sources.tables import table


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.import_edges(table(spark, d, "source_files"))


def span_map(spark: SparkSession, d: str) -> DataFrame:
    """G14."""
    return compose.span_map(table(spark, d, "chunks"))


def graph_context(spark: SparkSession, d: str) -> DataFrame:
    """G16."""
    return compose.graph_context(_edges(spark, d), graph.file_nodes(table(spark, d, "source_files")))


def guided_steps(spark: SparkSession, d: str) -> DataFrame:
    """Learning steps with the leading author of each file."""
    e = cut_lineage(_edges(spark, d))
    return compose.steps_with_experts(graph.topological_levels(e, graph.neighbours(e, linked_seeds(e))), table(spark, d, "blame"))


def handler_targets(spark: SparkSession, d: str) -> DataFrame:
    """J8."""
    f = table(spark, d, "source_files")
    return compose.handler_targets(chunking.endpoints(f), f, _edges(spark, d))


def change_locus(spark: SparkSession, d: str) -> DataFrame:
    """The first three sources among the nearest documents of every query."""
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    of = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("source", F.lit("unknown")).alias("path"))
    return compose.locus(retrieval.nearest(v, v.where("vec_id % 20 = 0"), 5), of)


def code_complexity(spark: SparkSession, d: str) -> DataFrame:
    """A35."""
    return compose.complexity(table(spark, d, "source_files"))


def config_files(spark: SparkSession, d: str) -> DataFrame:
    """A33."""
    return compose.config_files(table(spark, d, "source_files"))


def project_warnings(spark: SparkSession, d: str) -> DataFrame:
    """A38."""
    return compose.warnings(table(spark, d, "source_files"))


def doc_coverage(spark: SparkSession, d: str) -> DataFrame:
    """X12, A24."""
    return edits.doc_coverage(table(spark, d, "source_files"))


QUERIES = {f.__name__: f for f in (span_map, graph_context, guided_steps, handler_targets, change_locus, code_complexity, config_files, project_warnings, doc_coverage)}

from quillon.plans.code import EP as _EP  # noqa: E402
from quillon.plans.files import _LANG, _LINES  # noqa: E402
from quillon.plans.graphs import _E as _EDGES  # noqa: E402

_KINDS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in compose.CONFIG_FILES.items())
_EXT = r"lower(regexp_extract(file_path, '[^/.][^/]*(\.[^./]+)$', 1))"
ORACLES = {
    "code_complexity": f"SELECT repo_id, {_LANG} AS language, count(*) AS n_files, CAST(sum({_LINES}) AS BIGINT) AS n_lines, round(avg({_LINES}), 4) AS mean_lines, CAST(max({_LINES}) AS BIGINT) AS largest FROM source_files GROUP BY 1, 2",
    "graph_context": f"WITH {_EDGES}, g AS (SELECT repo_id, count(*) AS n_edges FROM (SELECT DISTINCT repo_id, source, target FROM e) GROUP BY 1), f AS (SELECT DISTINCT repo_id, file_path FROM source_files WHERE file_path IS NOT NULL) SELECT repo_id, count(*) AS n_nodes, coalesce(any_value(n_edges), 0) AS n_edges, array_to_string(list_sort(list(file_path))[1:5], ', ') AS sample FROM f LEFT JOIN g USING (repo_id) GROUP BY 1",
    "handler_targets": f"WITH {_EDGES}, {_EP}, g AS (SELECT repo_id, source AS file_path, count(DISTINCT target) AS n_targets FROM e GROUP BY 1, 2) SELECT ep.file_id, handler, path, coalesce(n_targets, 0) AS n_targets FROM ep JOIN source_files f ON f.file_id = ep.file_id LEFT JOIN g ON g.repo_id = f.repo_id AND g.file_path = f.file_path",
    "span_map": "SELECT file_id, count(*) AS n_spans, min(start_line) AS first_line, max(end_line) AS last_line FROM (SELECT DISTINCT file_id, chunk_id, start_line, end_line FROM chunks WHERE start_line IS NOT NULL AND end_line IS NOT NULL) GROUP BY 1",
    "change_locus": "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL), k AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_sum(list_transform(list_zip(q.e, v.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 6) AS distance FROM v q JOIN v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id AND len(q.e) = len(v.e)), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM k QUALIFY rank <= 5), f AS (SELECT query_id, coalesce(source, 'unknown') AS path, min(rank) AS best FROM r JOIN documents ON doc_id = id GROUP BY 1, 2) SELECT query_id, path, row_number() OVER (PARTITION BY query_id ORDER BY best, path) AS place FROM f QUALIFY place <= 3",
    "config_files": f"SELECT DISTINCT repo_id, file_path, CASE regexp_extract(file_path, '([^/]*)$', 1) {_KINDS} END AS kind FROM source_files WHERE kind IS NOT NULL",
    "project_warnings": "WITH a AS (SELECT repo_id, bool_or(regexp_matches(lower(file_path), '(^|/)readme')) AS r, bool_or(contains(lower(file_path), 'test')) AS t, bool_or(regexp_matches(lower(file_path), '(^|/)(licen[cs]e|copying)')) AS l, bool_or(file_size_kb > 51200) AS b FROM source_files GROUP BY 1) SELECT repo_id, 'no_readme' AS warning FROM a WHERE NOT r UNION ALL SELECT repo_id, 'no_tests' FROM a WHERE NOT t UNION ALL SELECT repo_id, 'no_license' FROM a WHERE NOT l UNION ALL SELECT repo_id, 'large_files' FROM a WHERE b",
}

"""Queries on chunks and endpoints of source files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import chunking, codegraph, shred
from quillon.sources.tables import table


def code_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks by language."""
    return chunking.chunks(table(spark, d, "source_files"))


def endpoints(spark: SparkSession, d: str) -> DataFrame:
    """X6."""
    return chunking.endpoints(table(spark, d, "source_files"))


def declared_endpoints(spark: SparkSession, d: str) -> DataFrame:
    """X6 without places, comparable with SQL."""
    return endpoints(spark, d).select("file_id", "framework", "path", F.array_join("methods", ",").alias("methods"), "handler", (F.col("end_line") - F.col("start_line")).cast("bigint").alias("span"))


def endpoint_inventory(spark: SparkSession, d: str) -> DataFrame:
    """A18."""
    return chunking.inventory(endpoints(spark, d))


def rest_scores(spark: SparkSession, d: str) -> DataFrame:
    """Per framework."""
    return chunking.rest_scores(endpoints(spark, d), "framework")


def openapi_specs(spark: SparkSession, d: str) -> DataFrame:
    """X15."""
    return chunking.openapi(endpoints(spark, d))


def nested_endpoint_scores(spark: SparkSession, d: str) -> DataFrame:
    """A19 on the endpoints kept in nested records."""
    found = shred.entity_table(shred.stored(table(spark, d, "cortex_raw")), "endpoint")
    return chunking.rest_scores(found.where(F.col("path").isNotNull()), "framework")


def express_endpoints(spark: SparkSession, d: str) -> DataFrame:
    """X6 for one framework and named handlers, comparable with SQL."""
    found = endpoints(spark, d).where("framework = 'Express' and not startswith(handler, 'anonymous_')")
    return found.select("file_id", F.col("methods")[0].alias("method"), "path", "handler")


def _facts(spark: SparkSession, d: str) -> DataFrame:
    return codegraph.facts(table(spark, d, "source_files"))


def code_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Files and classes of every ref, with their functions, classes, methods and exports."""
    return codegraph.nodes(_facts(spark, d))


def code_edges(spark: SparkSession, d: str) -> DataFrame:
    """Bases, imports and calls of every ref."""
    return codegraph.edges(_facts(spark, d))


def script_imports(spark: SparkSession, d: str) -> DataFrame:
    """What JavaScript files require and import."""
    return codegraph.edges(_facts(spark, d)).where("type = 'IMPORTS' and source rlike '[.](js|mjs|cjs|jsx|gs)$'").groupBy("repo_id", "source", "target").agg(F.count("*").alias("n"))


def script_functions(spark: SparkSession, d: str) -> DataFrame:
    """Functions that JavaScript files declare."""
    return codegraph.nodes(_facts(spark, d)).where("type = 'file' and language = 'javascript'").select("repo_id", "file", F.explode("functions").alias("name")).groupBy("repo_id", "file", "name").agg(F.count("*").alias("n"))


def class_methods(spark: SparkSession, d: str) -> DataFrame:
    """Methods by the class that holds them."""
    return codegraph.nodes(_facts(spark, d)).where("type = 'class'").select("repo_id", "ref", "node_id", "line", F.size("methods").alias("n_methods"), F.array_join("methods", ", ").alias("methods"))


def call_counts(spark: SparkSession, d: str) -> DataFrame:
    """Sources with the most calls."""
    return codegraph.call_counts(codegraph.edges(_facts(spark, d)))


def grouped_edges(spark: SparkSession, d: str) -> DataFrame:
    """A44."""
    return codegraph.grouped(codegraph.edges(_facts(spark, d)))


def handler_edges(spark: SparkSession, d: str) -> DataFrame:
    """What the node of each endpoint's handler leads to."""
    return codegraph.handler_edges(endpoints(spark, d), _facts(spark, d))


QUERIES = {f.__name__: f for f in (code_chunks, endpoints, declared_endpoints, endpoint_inventory, rest_scores, openapi_specs, nested_endpoint_scores, express_endpoints, code_nodes, code_edges, script_imports, script_functions, class_methods, call_counts, grouped_edges, handler_edges)}
_SCRIPTS = r"s AS (SELECT repo_id, file_path, arg_max(coalesce(raw_content, ''), file_id) AS t FROM source_files WHERE file_path IS NOT NULL GROUP BY repo_id, ref, file_path)"
_EXPRESS = r"(?i)app\.(?:get|post|put|delete|patch|use)\([''\"][^''\"]+[''\"],\s*\w+"
#: The forms that stand in the tables, without regard to how the operators read a text.
ORACLES = {
    "express_endpoints": rf"""WITH m AS (SELECT file_id, unnest(regexp_extract_all(raw_content, '{_EXPRESS}')) AS s FROM source_files
        WHERE regexp_matches(file_path, '\.(py|pyi|pyx|js|mjs|cjs|jsx|gs|ts|tsx|java|go|php|rb)$'))
        SELECT file_id, upper(regexp_extract(s, '(?i)app\.(\w+)', 1)) AS method, regexp_extract(s, '[''"]([^''"]+)[''"]', 1) AS path, regexp_extract(s, ',\s*(\w+)$', 1) AS handler FROM m""",
    "script_imports": rf"""WITH {_SCRIPTS}, m AS (SELECT repo_id, file_path AS source, unnest(regexp_extract_all(t, '(?:require\(|from )"([^"\n]+)"', 1)) AS target FROM s WHERE regexp_matches(file_path, '\.(js|mjs|cjs|jsx|gs)$'))
        SELECT repo_id, source, target, count(*) AS n FROM m GROUP BY ALL""",
    "script_functions": rf"""WITH {_SCRIPTS}, m AS (SELECT repo_id, file_path AS file, unnest(regexp_extract_all(t, '(?m)(?:^|[;{{}}])(?:export )?function (\w+)\(', 1)) AS name FROM s WHERE regexp_matches(file_path, '\.(js|mjs|cjs|jsx|gs)$'))
        SELECT repo_id, file, name, count(*) AS n FROM m GROUP BY ALL""",
}
_WEB = r"regexp_matches(lower(file_path), '\.(py|pyi|pyx|js|mjs|cjs|jsx|gs|ts|tsx|java|go|php|rb)$')"


def _routes(framework: str, whole: str, path: str, methods: str, handler: str) -> str:
    """Endpoints of one framework in the forms that stand in the tables; ``methods`` is an expression over s."""
    return f"SELECT file_id, '{framework}' AS framework, regexp_extract(s, '{path}', 1) AS path, {methods} AS methods, regexp_extract(s, '{handler}', 1) AS handler, length(s) - length(replace(s, chr(10), '')) AS span FROM (SELECT file_id, unnest(regexp_extract_all(raw_content, '{whole}')) AS s FROM source_files WHERE {_WEB})"


_VERB = lambda before: f"upper(regexp_extract(s, '{before}(get|post|put|delete|patch|use|GET|POST|PUT|DELETE|PATCH)', 1))"
EP = "ep AS (" + " UNION ALL ".join([
    _routes("Flask", r"""(?s)@[\w.]*\.route\("[^"]+".*?\)\s*\ndef\s+\w+""", r'route\("([^"]+)"', r"coalesce(nullif(replace(replace(upper(regexp_extract(s, 'methods=\[([^\]]+)\]\)\s*\ndef', 1)), chr(34), ''), ' ', ''), ''), 'GET')", r"def\s+(\w+)$"),
    _routes("FastAPI", r"""(?s)@[\w.]*\.(?:get|post|put|delete|patch)\("[^"]+".*?\)\s*\n(?:async\s+)?def\s+\w+""", r'\("([^"]+)"', _VERB(r"@[\w.]*\."), r"def\s+(\w+)$"),
    _routes("Express", r"""app\.(?:get|post|put|delete|patch|use)\("[^"]+",\s*\w+""", r'\("([^"]+)"', _VERB(r"app\."), r",\s*(\w+)$"),
    _routes("Gin", r"""(?:router|engine)\.(?:GET|POST|PUT|DELETE|PATCH)\("[^"]+",\s*\w+""", r'\("([^"]+)"', _VERB(r"^\w+\."), r",\s*(\w+)$"),
    _routes("Laravel", r"""Route::(?:get|post|put|delete|patch)\("[^"]+",\s*"[^"]+\"""", r'\("([^"]+)"', _VERB("Route::"), r',\s*"([^"]+)"$'),
]) + ")"
_POINTS = r"CASE WHEN contains(path, '/{') OR contains(path, '/id') OR regexp_matches(path, '/\d+') THEN 1.0 ELSE 0 END + CASE WHEN length(path) - length(replace(path, '/', '')) >= 2 THEN 0.5 ELSE 0 END + CASE WHEN regexp_matches(lower(path), 'create|update|delete|get|list') THEN 0 ELSE 0.5 END"
ORACLES |= {
    "declared_endpoints": f"WITH {EP} SELECT * FROM ep",
    "endpoint_inventory": f"WITH {EP} SELECT framework, method, count(*) AS n, count(DISTINCT file_id) AS n_files FROM (SELECT file_id, framework, unnest(string_split(methods, ',')) AS method FROM ep) GROUP BY ALL",
    "rest_scores": f"WITH {EP} SELECT framework, count(*) AS n, round(CAST(least(1, avg({_POINTS})) AS DOUBLE), 6) AS rest_score FROM ep GROUP BY 1",
}

"""Queries on manifests and whole repositories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.sources import manifests, stores, tree
from quillon.sources.tables import table


def manifest_dependencies(spark: SparkSession, d: str) -> DataFrame:
    """Dependencies stated in manifests."""
    return manifests.all_dependencies(table(spark, d, "source_files")).distinct()


def package_json_dependencies(spark: SparkSession, d: str) -> DataFrame:
    """S13."""
    return manifests.package_json(table(spark, d, "source_files")).distinct()


def docker_images(spark: SparkSession, d: str) -> DataFrame:
    """S14, P14, P29."""
    return manifests.dockerfiles(table(spark, d, "source_files"))


def context_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Files and length of each repository's concatenation."""
    return tree.context_sizes(table(spark, d, "source_files"))


def context_parts(spark: SparkSession, d: str) -> DataFrame:
    """The parts of each repository's concatenation, by the digest of their text."""
    return tree.concatenated(table(spark, d, "source_files")).select("repo_id", "file_path", "file_id", F.md5("text").alias("digest"))


def extension_histogram(spark: SparkSession, d: str) -> DataFrame:
    """S24."""
    return tree.extension_histogram(table(spark, d, "source_files"))


def complete_repositories(spark: SparkSession, d: str) -> DataFrame:
    """Repositories with files, authorship and dependencies."""
    return stores.catalogue(table(spark, d, "source_files"), table(spark, d, "blame"), table(spark, d, "dependencies"))


def crawl_times(spark: SparkSession, d: str) -> DataFrame:
    return stores.last_crawl(table(spark, d, "repos")).select("repo_id", F.unix_micros("crawled_at").cast("string").alias("crawled_us"), "has_zone")


QUERIES = {f.__name__: f for f in (manifest_dependencies, package_json_dependencies, docker_images, context_sizes, context_parts, extension_histogram, complete_repositories, crawl_times)}
_BASE = "regexp_extract(file_path, '([^/]*)$', 1)"
ORACLES = {
    "package_json_dependencies": " UNION ".join(
        f"SELECT repo_id, unnest(map_keys(m)) AS name, unnest(map_values(m)) AS version, '{k}' AS dependency_type, 'javascript' AS ecosystem FROM (SELECT repo_id, CAST(json_extract(raw_content, '$.{s}') AS MAP(VARCHAR, VARCHAR)) AS m FROM source_files WHERE {_BASE} = 'package.json' AND json_valid(raw_content))"
        for s, k in (("dependencies", "application"), ("devDependencies", "development"), ("peerDependencies", "peer"), ("optionalDependencies", "optional"))
    ),
    "docker_images": f"WITH i AS (SELECT repo_id, unnest(regexp_extract_all(raw_content, '(?mi)^FROM\\s+(\\S+)', 1)) AS image FROM source_files WHERE regexp_matches({_BASE}, '(?i)^dockerfile|\\.dockerfile$')), n AS (SELECT repo_id, split_part(image, ':', 1) AS name, CASE WHEN contains(image, ':') THEN split_part(image, ':', 2) ELSE 'latest' END AS version FROM i) SELECT repo_id, name, version, 'application' AS service_type FROM n WHERE NOT regexp_matches(name, '^[A-Za-z]+$')",
    "context_sizes": "SELECT repo_id, count(*) AS n_files, CAST(sum(length('=== ' || file_path || ' ===' || chr(10) || raw_content)) + count(*) - 1 AS BIGINT) AS n_chars FROM source_files WHERE strlen(raw_content) <= 262144 GROUP BY 1",
    "context_parts": "SELECT repo_id, file_path, file_id, md5('=== ' || file_path || ' ===' || chr(10) || raw_content) AS digest FROM source_files WHERE strlen(raw_content) <= 262144",
    "extension_histogram": r"SELECT lower(regexp_extract(file_path, '[^/.][^/]*(\.[^./]+)$', 1)) AS ext, count(*) AS n FROM source_files GROUP BY 1",
    "complete_repositories": "SELECT DISTINCT repo_id FROM source_files WHERE repo_id IN (SELECT repo_id FROM blame) AND repo_id IN (SELECT repo_id FROM dependencies)",
    "crawl_times": "SELECT repo_id, CAST(epoch_us(try_cast(last_crawled_utc AS TIMESTAMPTZ)) AS VARCHAR) AS crawled_us, coalesce(regexp_matches(trim(last_crawled_utc), '(Z|[+-]\\d{2}:?\\d{2})$'), false) AS has_zone FROM repos",
}
_PYPROJECT = f"SELECT DISTINCT repo_id, regexp_extract(x, '^[A-Za-z0-9][A-Za-z0-9_.-]*') AS name, coalesce(nullif(regexp_extract(x, '[<>=!~^].*$'), ''), 'any') AS version, 'application' AS dependency_type, 'python' AS ecosystem FROM (SELECT repo_id, unnest(regexp_extract_all(regexp_extract(raw_content, '(?m)^dependencies = \\[([^\\]]*)\\]', 1), '\"([^\"]+)\"', 1)) AS x FROM source_files WHERE {_BASE} = 'pyproject.toml')"
_SECTION = "regexp_extract(replace(raw_content, chr(13), ''), '(?s)\\[dependencies\\]\\n(.*)$', 1)"
_CARGO = f"SELECT DISTINCT repo_id, name, version, 'application' AS dependency_type, 'rust' AS ecosystem FROM (SELECT repo_id, unnest(regexp_extract_all({_SECTION}, '(?m)^([A-Za-z0-9_-]+) = \"([^\"]*)\"', 1)) AS name, unnest(regexp_extract_all({_SECTION}, '(?m)^([A-Za-z0-9_-]+) = \"([^\"]*)\"', 2)) AS version FROM source_files WHERE {_BASE} = 'Cargo.toml')"
ORACLES["manifest_dependencies"] = f"SELECT DISTINCT * FROM ({ORACLES['package_json_dependencies']} UNION ALL {_PYPROJECT} UNION ALL {_CARGO})"

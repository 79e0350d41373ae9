"""Queries over source files: classification, quality and corpus statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import lookup, paths, text
from quillon.operators import files, stats
from quillon.sources.tables import table

_FILES = "source_files"


def _map_sql(table_: dict[str, str], key: str, default: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table_.items())
    return f"CASE {key} {cases} ELSE {default} END"


_EXT = r"lower(regexp_extract(file_path, '[^/.][^/]*(\.[^./]+)$', 1))"
_LINES = "CASE WHEN coalesce(length(raw_content), 0) = 0 THEN 0 ELSE length(raw_content) - length(replace(raw_content, chr(10), '')) + CASE WHEN suffix(raw_content, chr(10)) THEN 0 ELSE 1 END END"
_LANG = _map_sql(lookup.LANGUAGE_BY_EXTENSION, _EXT, "'unknown'")
_SHOW = _map_sql(lookup.DISPLAY_BY_EXTENSION, f"CASE WHEN {_EXT} = '' THEN 'no_extension' ELSE {_EXT} END", f"concat('Unknown (', CASE WHEN {_EXT} = '' THEN 'no_extension' ELSE {_EXT} END, ')')")
_TEST = " OR ".join(f"contains(lower(file_path), '{m}')" for m in lookup.TEST_MARKS)
_NAME = "regexp_extract(file_path, '([^/]*)$', 1)"
_CATEGORY = f"CASE WHEN coalesce(file_path, '') = '' THEN 'other' WHEN {_TEST} THEN 'testing' ELSE coalesce({_map_sql(lookup.CATEGORY_BY_NAME, f'lower({_NAME})', 'NULL')}, {_map_sql(lookup.CATEGORY_BY_EXTENSION, _EXT, 'NULL')}, 'other') END"


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _any_sql(col: str, marks: list[str]) -> str:
    return "(" + " OR ".join(f"contains({col}, {_sql_text(m)})" for m in marks) + ")"


def file_classes(spark: SparkSession, d: str) -> DataFrame:
    """Language, display name, category and kind of every file."""
    return files.classified(table(spark, d, _FILES)).select("file_id", "ext", "language", "display_language", "category", "is_test", "is_doc", F.col("n_lines").cast("bigint").alias("n_lines"))


def token_counts(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of every file."""
    return table(spark, d, _FILES).select("file_id", text.token_count(F.col("raw_content")).cast("bigint").alias("n_tokens"))


def framework_hints(spark: SparkSession, d: str) -> DataFrame:
    """P5: one row per file and framework found."""
    return table(spark, d, _FILES).select("file_id", F.explode(files.frameworks(F.col("raw_content"))).alias("framework"))


def framework_signatures(spark: SparkSession, d: str) -> DataFrame:
    """The second, smaller table of signatures."""
    return table(spark, d, _FILES).select("file_id", F.explode(files.framework_signatures(F.col("raw_content"))).alias("framework"))


def code_smells(spark: SparkSession, d: str) -> DataFrame:
    """One row per file and smell."""
    rows = table(spark, d, _FILES)
    return rows.select("file_id", F.explode(files.smells(F.col("raw_content"), paths.language(F.col("file_path")))).alias("smell"))


def latest_files(spark: SparkSession, d: str) -> DataFrame:
    """The current version of every path of a ref."""
    return files.latest(table(spark, d, _FILES)).select("file_id", "repo_id", "ref", "file_path")


def scanned_files(spark: SparkSession, d: str) -> DataFrame:
    """Include globs, excluded directories, hidden parts."""
    return files.scan_filter(table(spark, d, _FILES), ["*.py", "*.js", "*.go", "Dockerfile*"]).select("file_id", "file_path")


def files_by_language(spark: SparkSession, d: str) -> DataFrame:
    """F9."""
    p = F.col("file_path")
    return table(spark, d, _FILES).where((paths.language(p) == "go") | (paths.suffix(p) == ".rs")).select("file_id", "file_path")


def files_by_pattern(spark: SparkSession, d: str) -> DataFrame:
    """directory, extension and glob patterns."""
    p = F.col("file_path")
    rows = table(spark, d, _FILES)
    one = lambda name, pattern: rows.where(paths.matches_pattern(p, pattern)).select(F.lit(name).alias("pattern"), "file_id")
    return one("dir", "src/").unionByName(one("ext", "*.go")).unionByName(one("glob", "lib/*_[a-m]*.py"))


def find_by_name(spark: SparkSession, d: str) -> DataFrame:
    """F8: unique, unique at the root, or ambiguous."""
    return files.find_by_name(table(spark, d, _FILES), "index.js").withColumn("n_options", F.col("n_options").cast("bigint"))


def safe_paths(spark: SparkSession, d: str) -> DataFrame:
    """F11."""
    return table(spark, d, _FILES).select("file_id", paths.safe_path(F.col("file_path")).alias("is_safe"))


def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    """One file of one repository, its first path."""
    f = table(spark, d, _FILES).where("repo_id = 'brinewick_tide-compiler'")
    return f.join(F.broadcast(f.agg(F.min("file_path").alias("file_path"))), "file_path").select("file_id", "raw_content")  # one row is broadcast


def ast_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Chunk types and named constructs per file."""
    return files.ast_summary(table(spark, d, "chunks")).select("file_id", "total_chunks", "n_named")


def language_stats(spark: SparkSession, d: str) -> DataFrame:
    """A1: files, lines, chunks and frameworks per repository and language."""
    return stats.language_stats(table(spark, d, _FILES), table(spark, d, "chunks"))


def polyglot_summary(spark: SparkSession, d: str) -> DataFrame:
    """A2: languages, the leading one and totals per repository."""
    return stats.polyglot_summary(stats.language_stats(table(spark, d, _FILES), table(spark, d, "chunks")))


def crawl_language_stats(spark: SparkSession, d: str) -> DataFrame:
    """A3: display languages with their extensions and example paths."""
    return stats.display_stats(table(spark, d, _FILES))


def directory_stats(spark: SparkSession, d: str) -> DataFrame:
    """Totals and depth per repository."""
    return stats.directory_stats(table(spark, d, _FILES))


def health_scores(spark: SparkSession, d: str) -> DataFrame:
    """A5."""
    return stats.health(table(spark, d, _FILES))


def languages_by_lines(spark: SparkSession, d: str) -> DataFrame:
    """Files and lines of six extensions."""
    return stats.languages_by_lines(table(spark, d, _FILES))


def config_file_counts(spark: SparkSession, d: str) -> DataFrame:
    """Configuration files per repository and kind."""
    return stats.config_counts(table(spark, d, _FILES))


def framework_votes(spark: SparkSession, d: str) -> DataFrame:
    """Indicators found per framework, the primary one and its confidence."""
    return stats.framework_votes(table(spark, d, _FILES))


def naming_conventions(spark: SparkSession, d: str) -> DataFrame:
    """Counts per repository, kind of name and convention."""
    return stats.naming(table(spark, d, _FILES))


def top_modules(spark: SparkSession, d: str) -> DataFrame:
    """The ten most imported modules of every repository."""
    return stats.top_modules(table(spark, d, _FILES))


def testing_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Test files and frameworks per repository."""
    return stats.testing(table(spark, d, _FILES))


def polyglot_priority(spark: SparkSession, d: str) -> DataFrame:
    """The primary language by files times weight."""
    return stats.primary_by_weight(table(spark, d, _FILES))


def ecosystems(spark: SparkSession, d: str) -> DataFrame:
    """Ecosystems by root files, else by extensions; one primary."""
    return stats.ecosystems(table(spark, d, _FILES))


def file_relationships(spark: SparkSession, d: str) -> DataFrame:
    """Categories of a repository's files, the leading ones and the complexity."""
    return stats.relationships(table(spark, d, _FILES))


def structure_tree(spark: SparkSession, d: str) -> DataFrame:
    """The first twenty sorted paths as an indented tree."""
    return stats.structure_tree(table(spark, d, _FILES))


def snapshot_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Test and implementation files and their ratio."""
    return stats.snapshot(table(spark, d, _FILES))


QUERIES = {
    f.__name__: f
    for f in (
        file_classes, token_counts, framework_hints, framework_signatures, code_smells, latest_files, scanned_files, files_by_language, files_by_pattern, find_by_name, safe_paths, point_lookup, ast_summaries,
        language_stats, polyglot_summary, crawl_language_stats, directory_stats, health_scores, languages_by_lines, config_file_counts, framework_votes, naming_conventions, top_modules, testing_patterns,
        polyglot_priority, ecosystems, file_relationships, structure_tree, snapshot_metrics,
    )
}

_OCC = lambda part: f"CAST((length(raw_content) - length(replace(raw_content, {_sql_text(part)}, ''))) / {len(part)} AS INT)"
_SMELLS = [
    (f"({_LINES}) > 1000", "very_large_file"), ("length(raw_content) > 100000", "large_file_size"), ("lang = 'python' AND contains(raw_content, 'import *')", "wildcard_import"),
    (f"lang = 'python' AND {_OCC('except:')} > {_OCC('except ')}", "bare_except"), (f"lang = 'python' AND len(list_filter(string_split(raw_content, chr(10)), lambda x: length(trim(x)) > 100)) > ({_LINES}) * 0.1", "long_lines"),
    ("lang IN ('javascript', 'typescript') AND contains(raw_content, 'eval(')", "eval_usage"), (f"lang IN ('javascript', 'typescript') AND {_OCC('var ')} > {_OCC('let ')} + {_OCC('const ')}", "var_over_let_const"),
    (f"lang = 'java' AND {_OCC('public class')} > 1", "multiple_public_classes"), ("lang = 'java' AND contains(raw_content, 'System.out.print')", "system_out_usage"),
    *[(f"contains(lower(raw_content), '{w}')", f"potential_{w}_exposure") for w in lookup.SECURITY_WORDS],
]
_EXCLUDED = ", ".join(f"'{x}'" for x in lookup.EXCLUDED_DIRECTORIES)
_DISTINCT_PATHS = "(SELECT DISTINCT repo_id, file_path FROM source_files WHERE file_path IS NOT NULL)"

ORACLES = {
    "file_classes": f"SELECT file_id, {_EXT} AS ext, {_LANG} AS language, {_SHOW} AS display_language, {_CATEGORY} AS category, contains(lower(file_path), 'test') OR contains(lower(file_path), 'spec') AS is_test, regexp_matches(lower(file_path), 'readme|doc|changelog|contributing') AS is_doc, CAST({_LINES} AS BIGINT) AS n_lines FROM source_files",
    "token_counts": r"SELECT file_id, CAST(coalesce(len(list_filter(regexp_split_to_array(raw_content, '[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+'), lambda x: x <> '')), 0) AS BIGINT) AS n_tokens FROM source_files",
    "framework_hints": " UNION ALL ".join(f"SELECT file_id, '{n}' AS framework FROM source_files WHERE {_any_sql('lower(raw_content)', m)}" for n, m in lookup.FRAMEWORK_MARKS.items()),
    "framework_signatures": " UNION ALL ".join(f"SELECT file_id, '{n}' AS framework FROM source_files WHERE {_any_sql('lower(raw_content)', m)}" for n, m in lookup.FRAMEWORK_SIGNATURES.items()),
    "code_smells": f"WITH s AS (SELECT *, {_LANG} AS lang FROM source_files) " + " UNION ALL ".join(f"SELECT file_id, '{n}' AS smell FROM s WHERE {c}" for c, n in _SMELLS),
    "latest_files": "SELECT file_id, repo_id, ref, file_path FROM source_files QUALIFY row_number() OVER (PARTITION BY repo_id, ref, file_path ORDER BY crawled_at DESC, file_id DESC) = 1",
    "scanned_files": f"SELECT file_id, file_path FROM source_files WHERE (suffix({_NAME}, '.py') OR suffix({_NAME}, '.js') OR suffix({_NAME}, '.go') OR prefix({_NAME}, 'Dockerfile')) AND NOT list_has_any(string_split(file_path, '/')[:-2], [{_EXCLUDED}]) AND len(list_filter(string_split(file_path, '/'), lambda x: prefix(x, '.'))) = 0",
    "files_by_language": f"SELECT file_id, file_path FROM source_files WHERE {_LANG} = 'go' OR {_EXT} = '.rs'",
    "files_by_pattern": "SELECT 'dir' AS pattern, file_id FROM source_files WHERE prefix(file_path, 'src/') OR contains(file_path, '/src/') UNION ALL SELECT 'ext', file_id FROM source_files WHERE suffix(file_path, '.go') UNION ALL SELECT 'glob', file_id FROM source_files WHERE regexp_full_match(file_path, 'lib/.*_[a-m].*\\.py')",
    "find_by_name": f"WITH h AS (SELECT DISTINCT repo_id, file_path FROM source_files WHERE {_NAME} = 'index.js') SELECT repo_id, CASE WHEN count(*) = 1 OR bool_or(NOT contains(file_path, '/')) THEN 'found' ELSE 'ambiguous' END AS status, CASE WHEN count(*) = 1 THEN max(file_path) ELSE max(CASE WHEN NOT contains(file_path, '/') THEN file_path END) END AS file_path, count(*) AS n_options FROM h GROUP BY repo_id",
    "safe_paths": r"SELECT file_id, NOT (contains(file_path, '..') OR prefix(file_path, '/') OR contains(file_path, '\')) AS is_safe FROM source_files",
    "point_lookup": "SELECT file_id, raw_content FROM source_files WHERE repo_id = 'brinewick_tide-compiler' AND file_path = (SELECT min(file_path) FROM source_files WHERE repo_id = 'brinewick_tide-compiler')",
    "ast_summaries": "SELECT file_id, count(*) AS total_chunks, count(name) AS n_named FROM chunks GROUP BY file_id",
    **stats.oracles(_LANG, _SHOW, _CATEGORY, _EXT, _LINES, _NAME, _any_sql),
}
ORACLES["health_scores"] = f"""WITH sm AS (SELECT file_id, count(*) AS n FROM ({ORACLES["code_smells"]}) GROUP BY 1),
    b AS (SELECT repo_id, {_LANG} AS lang, coalesce(n, 0) AS n, regexp_matches(lower(file_path), 'readme|doc|changelog|contributing') AS doc, contains(lower(file_path), 'test') OR contains(lower(file_path), 'spec') AS test FROM source_files LEFT JOIN sm USING (file_id)),
    a AS (SELECT repo_id, count(*) AS files, sum(n) AS smells, count(DISTINCT lang) AS langs, count_if(doc) AS docs, count_if(test) AS tests FROM b GROUP BY 1)
    SELECT repo_id, files, round((greatest(0, 1 - smells / files / 10) + CASE WHEN langs = 1 THEN 0.8 WHEN langs <= 5 THEN 1 ELSE greatest(0.5, 1 - (langs - 5) * 0.1) END + least(1, docs / 3) + least(1, tests / files * 5)) / 4, 4) AS health FROM a"""

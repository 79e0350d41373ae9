"""Queries on diffs, plans of edits, ranked issues and blame output. The tables hold none of these as text, so the texts are written from their columns by one expression and read back by the operators."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import paths
from quillon.operators import compose, diffs, edits
from quillon.sources import tree
from quillon.sources.tables import table


def _diffs(spark: SparkSession, d: str) -> DataFrame:
    """(diff_id, diff_text): one section per file of a repository's ref, with one hunk whose place and length come from the file's id."""
    f = table(spark, d, "source_files").where("file_path is not null and not contains(file_path, ' ')")
    old = F.when(F.col("file_id") % 11 == 0, "/dev/null").otherwise(F.concat(F.lit("a/"), "file_path"))
    new = F.when((F.col("file_id") % 13 == 0) & (F.col("file_id") % 11 != 0), "/dev/null").otherwise(F.concat(F.lit("b/"), "file_path"))
    lines = lambda sign, n: F.repeat(F.lit(f"{sign}x\n"), n.cast("int"))
    text = F.concat(F.lit("diff --git a/"), "file_path", F.lit(" b/"), "file_path", F.lit("\n--- "), old, F.lit("\n+++ "), new, F.format_string("\n@@ -1,%d +%d,%d @@\n", F.col("file_id") % 5, F.col("file_id") % 50 + 1, F.col("file_id") % 7), lines("+", F.col("file_id") % 7), lines("-", F.col("file_id") % 5))
    return f.select(F.col("file_id").cast("string").alias("diff_id"), text.alias("diff_text"))


def diff_hunks(spark: SparkSession, d: str) -> DataFrame:
    """Files, line counts and places of a diff."""
    return diffs.hunks(_diffs(spark, d)).select("diff_id", "file_path", "status", *[F.col(c).cast("bigint").alias(c) for c in ("added", "removed", "start", "len")])


def diff_totals(spark: SparkSession, d: str) -> DataFrame:
    """A25."""
    return diffs.totals(diffs.hunks(_diffs(spark, d))).select("diff_id", "n_files", "added", "removed", "n_new", "n_deleted", "summary")


def diff_like_files(spark: SparkSession, d: str) -> DataFrame:
    """how many texts look like a diff, of files and of diffs."""
    texts = table(spark, d, "source_files").select(F.lit("file").alias("kind"), F.col("raw_content").alias("t")).unionByName(_diffs(spark, d).select(F.lit("diff").alias("kind"), F.col("diff_text").alias("t")))
    return texts.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(diffs.valid_diff(F.col("t"))).alias("n_valid"))


def ranked_issues(spark: SparkSession, d: str) -> DataFrame:
    """Documents as issues, ranked by the quality score of their label."""
    scores = table(spark, d, "labels").where("quality is not null").groupBy(F.col("doc_id").alias("issue_number")).agg(F.max("quality").alias("score"))
    issues = table(spark, d, "documents").select(F.col("doc_id").alias("number"), F.coalesce("source", F.lit("unknown")).alias("source"))
    return compose.ranked_issues(scores, issues).select("number", "source", "score", "rank")


def _plan(spark: SparkSession, d: str) -> DataFrame:
    """An operation per Python file: its first function replaced, a file made, a field added, an operation that is unknown or lacks a field."""
    f = table(spark, d, "source_files").where("file_path like '%.py' and repo_id is not null")
    name = F.regexp_extract(F.coalesce("raw_content", F.lit("")), r"(?m)^def (\w+)\(", 1)
    kind = F.when(F.col("file_id") % 4 == 0, "CREATE_FILE").when(F.col("file_id") % 4 == 1, "REPLACE_BLOCK").when(F.col("file_id") % 4 == 2, "ADD_FIELD_TO_STRUCT").otherwise("RENAME")
    return f.select("repo_id", F.concat_ws(":", "repo_id", "file_path").alias("file_path"), F.col("file_id").alias("seq"), kind.alias("operation"), F.when(name != "", name).alias("target_identifier"), F.lit("def renewed():\n    return 1").alias("content"))


def checked_plans(spark: SparkSession, d: str) -> DataFrame:
    """problems of every operation."""
    return edits.checked_plan(_plan(spark, d)).select("seq", "operation", F.array_join("problems", ",").alias("problems"))


def applied_plans(spark: SparkSession, d: str) -> DataFrame:
    """What a plan does to each file."""
    f = table(spark, d, "source_files").where("file_path like '%.py' and repo_id is not null").withColumn("file_path", F.concat_ws(":", "repo_id", "file_path"))
    last = f.groupBy("file_path").agg(F.max_by("raw_content", "file_id").alias("text")).withColumn("language", F.lit("python"))
    return edits.apply_plan(last, _plan(spark, d)).select("file_path", F.length("new_text").cast("bigint").alias("n_chars"), "n_ok", "n_failed")


def planned_files(spark: SparkSession, d: str) -> DataFrame:
    """Paths of a plan with their contents; every fifth path does not exist yet."""
    f = table(spark, d, "source_files").where("file_path is not null")
    plan = f.select("repo_id", F.when(F.col("file_id") % 5 == 0, F.concat("file_path", F.lit(".new"))).otherwise(F.col("file_path")).alias("file_path")).distinct()
    return compose.plan_files(plan, f).select("repo_id", "file_path", F.md5("raw_content").alias("digest"))


def valid_tests(spark: SparkSession, d: str) -> DataFrame:
    """How many Python files would do as a test, per repository; they are parsed and never run."""
    @F.pandas_udf("boolean")
    def valid(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: edits.valid_test(t if isinstance(t, str) else ""))

    f = table(spark, d, "source_files").where(paths.language(F.col("file_path")) == "python")
    # A test of our own is put before every third file, as the tables hold none.
    text = F.when(F.col("file_id") % 3 == 0, F.concat(F.lit("def test_it():\n    assert True\n\n\n"), F.coalesce("raw_content", F.lit("")))).otherwise(F.col("raw_content"))
    return f.withColumn("v", valid(text)).groupBy("repo_id").agg(F.count("*").alias("n_files"), F.count_if("v").alias("n_valid"))


def blame_counts(spark: SparkSession, d: str) -> DataFrame:
    """Lines per author, from blame output written out of the counts and read back."""
    b = table(spark, d, "blame").where("repo_id is not null and file_path is not null and email is not null and line_count > 0").distinct()
    sha = F.sha1(F.concat_ws("|", "repo_id", "file_path", "email"))
    one = F.concat(sha, F.lit(" 1 1 1\nauthor X\nauthor-mail <"), "email", F.lit(">\n\tcode\n"))
    text = b.select("repo_id", "file_path", F.repeat(one, F.least("line_count", F.lit(40)).cast("int")).alias("t"), "email").groupBy("repo_id", "file_path").agg(F.array_join(F.array_sort(F.collect_list("t")), "").alias("porcelain"))
    return tree.blame_counts(tree.blame_lines(text))


QUERIES = {f.__name__: f for f in (diff_hunks, diff_totals, diff_like_files, ranked_issues, checked_plans, applied_plans, planned_files, valid_tests, blame_counts)}

_D = "f AS (SELECT *, CASE WHEN file_id % 11 = 0 THEN 'added' WHEN file_id % 13 = 0 THEN 'deleted' ELSE 'modified' END AS status, file_id % 7 AS added, file_id % 5 AS removed FROM source_files WHERE file_path IS NOT NULL AND NOT contains(file_path, ' '))"
_DIFFLIKE = "(?m)^diff --git |^@@ -\\d+|^--- |^\\+\\+\\+ "
_P = "p AS (SELECT file_id AS seq, CASE file_id % 4 WHEN 0 THEN 'CREATE_FILE' WHEN 1 THEN 'REPLACE_BLOCK' WHEN 2 THEN 'ADD_FIELD_TO_STRUCT' ELSE 'RENAME' END AS operation, nullif(regexp_extract(coalesce(raw_content, ''), '(?m)^def (\\w+)\\(', 1), '') AS target FROM source_files WHERE file_path LIKE '%.py' AND repo_id IS NOT NULL)"
ORACLES = {
    "diff_hunks": f"WITH {_D} SELECT CAST(file_id AS VARCHAR) AS diff_id, file_path, status, added, removed, file_id % 50 + 1 AS start, added AS len FROM f",
    "diff_totals": f"WITH {_D} SELECT CAST(file_id AS VARCHAR) AS diff_id, CAST(1 AS BIGINT) AS n_files, added, removed, CAST(CASE status WHEN 'added' THEN 1 ELSE 0 END AS BIGINT) AS n_new, CAST(CASE status WHEN 'deleted' THEN 1 ELSE 0 END AS BIGINT) AS n_deleted, '1 file changed, ' || added || ' added and ' || removed || ' removed line' || CASE WHEN removed = 1 THEN '' ELSE 's' END AS summary FROM f",
    "diff_like_files": f"WITH {_D} SELECT 'file' AS kind, count(*) AS n, CAST(count_if(coalesce(regexp_matches(raw_content, '{_DIFFLIKE}'), false)) AS BIGINT) AS n_valid FROM source_files UNION ALL SELECT 'diff', count(*), count(*) FROM f",
    "ranked_issues": "WITH s AS (SELECT doc_id AS number, max(quality) AS score FROM labels WHERE quality IS NOT NULL GROUP BY 1) SELECT number, coalesce(source, 'unknown') AS source, score, row_number() OVER (ORDER BY score DESC, number) AS rank FROM s JOIN documents ON doc_id = number",
    "checked_plans": f"WITH {_P} SELECT seq, operation, CASE WHEN operation = 'RENAME' THEN 'unknown operation' WHEN operation <> 'CREATE_FILE' AND target IS NULL THEN 'target_identifier' ELSE '' END AS problems FROM p",
    "planned_files": "WITH l AS (SELECT repo_id, file_path, arg_max(raw_content, file_id) AS t FROM source_files GROUP BY 1, 2), p AS (SELECT DISTINCT repo_id, CASE WHEN file_id % 5 = 0 THEN file_path || '.new' ELSE file_path END AS file_path FROM source_files WHERE file_path IS NOT NULL) SELECT p.repo_id, p.file_path, md5(coalesce(t, '')) AS digest FROM p LEFT JOIN l ON l.repo_id = p.repo_id AND l.file_path = p.file_path",
    "blame_counts": "SELECT repo_id, file_path, email, CAST(sum(least(line_count, 40)) AS BIGINT) AS line_count FROM (SELECT DISTINCT repo_id, file_path, email, line_count FROM blame WHERE repo_id IS NOT NULL AND file_path IS NOT NULL AND email IS NOT NULL AND line_count > 0) GROUP BY 1, 2, 3",
}

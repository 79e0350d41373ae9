"""Queries on authorship and metric snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import expertise, series
from quillon.sources.tables import table

_COLS = ["repo_id", "email", "name", "lines", "files_involved", "share", "score", "rank"]


def author_contributions(spark: SparkSession, d: str) -> DataFrame:
    """A6."""
    return expertise.contributions(table(spark, d, "blame"))


def file_experts(spark: SparkSession, d: str) -> DataFrame:
    """A7, A10, W1, P13."""
    return expertise.file_experts(table(spark, d, "blame")).select("repo_id", "file_path", "email", "name", "lines", "share", "score", "rank")


def module_experts(spark: SparkSession, d: str) -> DataFrame:
    """A8, F4."""
    return expertise.module_experts(table(spark, d, "blame"), "src/").select(*_COLS)


def repo_experts(spark: SparkSession, d: str) -> DataFrame:
    """A9."""
    return expertise.repo_experts(table(spark, d, "blame")).select(*_COLS)


def metric_changes(spark: SparkSession, d: str) -> DataFrame:
    """Lag over all snapshots."""
    return series.changes(table(spark, d, "metrics")).withColumn("ts", F.unix_micros("ts"))


def latest_metric_changes(spark: SparkSession, d: str) -> DataFrame:
    """The last two snapshots."""
    return series.latest_changes(table(spark, d, "metrics")).withColumn("ts", F.unix_micros("ts"))


def daily_metrics(spark: SparkSession, d: str) -> DataFrame:
    """S21, D12."""
    return series.daily(table(spark, d, "metrics")).withColumn("day", F.col("day").cast("string"))


QUERIES = {f.__name__: f for f in (author_contributions, file_experts, module_experts, repo_experts, metric_changes, latest_metric_changes, daily_metrics)}

_BLAME = "b AS (SELECT repo_id, file_path, coalesce(nullif(trim(email), ''), 'unknown@example.com') AS email, CAST(sum(line_count) AS BIGINT) AS lines FROM (SELECT DISTINCT * FROM blame) GROUP BY ALL)"
_NAME = "array_to_string(list_transform(string_split(trim(regexp_replace(split_part(email, '@', 1), '[._\\- ]+', ' ', 'g')), ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ')"


def _ranked(base: str, keys: str, cols: str) -> str:
    return f"""WITH {_BLAME}, p AS ({base}), s AS (SELECT *, CASE WHEN sum(lines) OVER (PARTITION BY {keys}) > 0 THEN lines / sum(lines) OVER (PARTITION BY {keys}) * 100 ELSE 0 END AS sh,
        row_number() OVER (PARTITION BY {keys} ORDER BY lines DESC, email) AS rank FROM p)
        SELECT {cols}, email, {_NAME} AS name, lines, round(sh, 4) AS share, round(least(100, CASE WHEN sh >= 50 THEN 90 + (sh - 50) * 0.2 ELSE sh * 1.8 END), 4) AS score, rank FROM s WHERE rank <= 10"""


_SUM = "SELECT repo_id, email, CAST(sum(lines) AS BIGINT) AS lines, count(DISTINCT file_path) AS files_involved FROM b {} GROUP BY 1, 2"
_CLEAN = "m AS (SELECT repo_id, metric, ts, value FROM metrics QUALIFY row_number() OVER (PARTITION BY repo_id, metric, ts ORDER BY loaded_at DESC NULLS LAST, value DESC NULLS LAST) = 1)"
_CHANGES = f"WITH {_CLEAN}, l AS (SELECT *, lag(value) OVER (PARTITION BY repo_id, metric ORDER BY ts) AS previous FROM m WHERE value IS NOT NULL), c AS (SELECT *, round(CASE WHEN previous <> 0 THEN (value - previous) / abs(previous) * 100 END, 4) AS change_pct FROM l)"
ORACLES = {
    "author_contributions": f"WITH {_BLAME} SELECT * FROM b",
    "file_experts": _ranked("SELECT * FROM b", "repo_id, file_path", "repo_id, file_path"),
    "module_experts": _ranked(_SUM.format("WHERE prefix(file_path, 'src/') OR contains(file_path, '/src/')"), "repo_id", "repo_id, files_involved"),
    "repo_experts": _ranked(_SUM.format(""), "repo_id", "repo_id, files_involved"),
    "metric_changes": f"{_CHANGES} SELECT * REPLACE (epoch_us(ts) AS ts) FROM c",
    "latest_metric_changes": f"{_CHANGES}, r AS (SELECT *, row_number() OVER (PARTITION BY repo_id, metric ORDER BY ts DESC) AS r FROM c) SELECT * EXCLUDE (r) REPLACE (epoch_us(ts) AS ts) FROM r WHERE r = 1 AND change_pct IS NOT NULL",
    "daily_metrics": f"WITH {_CLEAN} SELECT repo_id, metric, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n, round(avg(value), 6) AS mean_value FROM m GROUP BY 1, 2, 3",
}

"""Who knows a file, a module or a repository, from authorship counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.paths import matches_pattern
from quillon.functions.text import name_from_email

NOBODY = "unknown@example.com"


def contributions(blame: DataFrame) -> DataFrame:
    """(repo_id, file_path, email, lines): repeated rows count once, a missing address gets a name of its own."""
    return (
        blame.distinct()
        .withColumn("email", F.coalesce(F.nullif(F.trim("email"), F.lit("")), F.lit(NOBODY)))
        .groupBy("repo_id", "file_path", "email")
        .agg(F.sum("line_count").alias("lines"))
    )


def score(share: Column) -> Column:
    """Piecewise score of a share in percent, at most 100."""
    return F.least(F.lit(100.0), F.when(share >= 50, 90 + (share - 50) * 0.2).otherwise(share * 1.8))


def _ranked(per: DataFrame, keys: list[str], top: int) -> DataFrame:
    total = F.sum("lines").over(Window.partitionBy(*keys))
    order = Window.partitionBy(*keys).orderBy(F.desc("lines"), "email")
    share = F.when(total > 0, F.col("lines") / total * 100).otherwise(0.0)
    out = per.withColumn("share", share).withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= top)
    return out.withColumn("score", F.round(score(F.col("share")), 4)).withColumn("share", F.round("share", 4)).withColumn("name", name_from_email(F.col("email")))


def file_experts(blame: DataFrame, top: int = 10) -> DataFrame:
    """Shares of every file, the leading authors first."""
    return _ranked(contributions(blame), ["repo_id", "file_path"], top)


def module_experts(blame: DataFrame, pattern: str, top: int = 10) -> DataFrame:
    """Authors of the files that match a pattern."""
    base = contributions(blame).where(matches_pattern(F.col("file_path"), pattern))
    per = base.groupBy("repo_id", "email").agg(F.sum("lines").alias("lines"), F.countDistinct("file_path").alias("files_involved"))
    return _ranked(per, ["repo_id"], top)


def repo_experts(blame: DataFrame, top: int = 10) -> DataFrame:
    """Authors of a whole repository."""
    per = contributions(blame).groupBy("repo_id", "email").agg(F.sum("lines").alias("lines"), F.countDistinct("file_path").alias("files_involved"))
    return _ranked(per, ["repo_id"], top)

"""Reading and writing whole repositories: nested documents, partitioned tables, append tables, catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

DOCUMENT = (
    "repo_id string, last_crawled_utc string, project_health_score double, project_structure_tree string, files array<struct<file_path string, file_size_kb double, raw_content string, detected_language string,"
    " code_smells array<string>, framework_hints array<string>, ast_summary string, text_chunks array<struct<chunk_id string, chunk_text string, token_count int, chunk_type string, language string, start_line int, end_line int>>>>"
)


class NotFound(Exception):
    """There is nothing at the path."""


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole-file JSON documents with a fixed schema; malformed ones stop the query, a missing path raises NotFound."""
    try:
        return spark.read.schema(DOCUMENT).option("multiLine", True).option("mode", "FAILFAST").json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise NotFound(path) from e
        raise


def write_table(df: DataFrame, path: str) -> None:
    """Replaces the partitions of the repositories in ``df``, and no others. The job commits as a whole, so a failure leaves the old data."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo_id").parquet(path)


def append_metrics(df: DataFrame, path: str) -> None:
    df.write.mode("append").partitionBy("metric").parquet(path)


def delete_repository(spark: SparkSession, path: str, repo_id: str) -> bool:
    """Drops the partition of one repository; False if there is none."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{path}/repo_id={jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(repo_id)}")
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True))


def catalogue(*parts: DataFrame) -> DataFrame:
    """Repositories that all the given tables know, in order."""
    out = parts[0].select("repo_id").distinct()
    for p in parts[1:]:
        out = out.join(p.select("repo_id"), "repo_id", "left_semi")
    return out.orderBy("repo_id")


def last_crawl(repos: DataFrame) -> DataFrame:
    """Crawl times as timestamps: text with a zone is taken as it is, text without one as UTC, unreadable text as null."""
    t = F.trim(F.col("last_crawled_utc"))
    zoned = t.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    return repos.withColumn("crawled_at", F.expr("try_cast(trim(last_crawled_utc) as timestamp)")).withColumn("has_zone", F.coalesce(zoned, F.lit(False)))

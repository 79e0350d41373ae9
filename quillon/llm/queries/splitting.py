"""Queries of problem 7."""

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import splitting
from quillon.sources.tables import table


def p7_pieces(spark: SparkSession, d: str) -> DataFrame:
    files = splitting.pieces(table(spark, d, "source_files"), "file", "file_id", "raw_content")
    chunks = splitting.pieces(table(spark, d, "chunks"), "chunk", "chunk_id", "chunk_text", "start_line")
    return files.unionByName(chunks).dropDuplicates(["kind", "item", "piece", "start_line", "n_chars", "text"])


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Items that the operator cuts."""
    files = splitting.pieces(table(spark, d, "source_files"), "file", "file_id", "raw_content")
    chunks = splitting.pieces(table(spark, d, "chunks"), "chunk", "chunk_id", "chunk_text", "start_line")
    return files.unionByName(chunks).where("piece = 0 and n_pieces > 1").select("kind", "item").distinct()


QUERIES = {"p7_found": p7_found, "p7_pieces": p7_pieces}
ORACLES: dict[str, str] = {
    "p7_found": r"""
        WITH items AS (
            SELECT 'file' AS kind, CAST(file_id AS VARCHAR) AS item, raw_content AS t FROM source_files
            UNION ALL SELECT 'chunk', chunk_id, chunk_text FROM chunks)
        SELECT DISTINCT kind, item FROM items
        WHERE length(t) > 8000
           OR len(list_filter(regexp_split_to_array(t, '[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+'), lambda x: x <> '')) > 800
    """,
}

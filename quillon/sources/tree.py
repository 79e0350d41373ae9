"""A directory tree as a table: a Python data source, and decoding of its bytes."""

from __future__ import annotations

import fnmatch
import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillon.functions.lookup import EXCLUDED_DIRECTORIES

SCHEMA = "file_path string, size bigint, modified timestamp, content binary"


class _Files(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


class TreeReader(DataSourceReader):
    """Lists paths once on the driver, reads contents in partitions of about ``partitionBytes``.

    Names that begin with ``_`` or ``.`` are kept apart from hidden directories, which a plain binary file scan would skip.
    """

    def __init__(self, options) -> None:
        self.root = options["path"]
        self.globs = [g for g in options.get("globs", "*").split(",") if g]
        self.excluded = {x for x in options.get("excluded", ",".join(EXCLUDED_DIRECTORIES)).split(",") if x}
        self.hidden = options.get("includeHidden", "false").lower() == "true"
        self.special = {x for x in options.get("special", "").split(",") if x}
        self.most = int(options.get("partitionBytes", 64 * 1024 * 1024))

    def wanted(self, rel: str) -> bool:
        *dirs, name = rel.split("/")
        if any(x in self.excluded for x in dirs) or not self.hidden and any(x.startswith(".") for x in dirs):
            return False
        if name.startswith(".") and not self.hidden and name not in self.special:
            return False
        return name in self.special or any(fnmatch.fnmatchcase(name, g) for g in self.globs)

    def partitions(self) -> list[InputPartition]:
        out, held, size = [], [], 0
        for base, dirs, names in os.walk(self.root):
            dirs.sort()
            for name in sorted(names):
                full = os.path.join(base, name)
                rel = os.path.relpath(full, self.root).replace(os.sep, "/")
                if not self.wanted(rel):
                    continue
                held.append(rel)
                size += os.path.getsize(full)
                if size >= self.most or len(held) >= 10_000:
                    out.append(_Files(held))
                    held, size = [], 0
        return [*out, _Files(held)] if held or not out else out

    def read(self, partition) -> Iterator[tuple]:
        import datetime

        for rel in partition.paths:
            full = os.path.join(self.root, rel)
            with open(full, "rb") as f:
                data = f.read()
            at = datetime.datetime.fromtimestamp(os.path.getmtime(full), datetime.timezone.utc)
            yield rel, len(data), at, data


class TreeSource(DataSource):
    """``spark.read.format("source_tree").option("path", dir)``; options globs, excluded, includeHidden, special, partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(self.options)


def read_tree(spark: SparkSession, path: str, **options: str) -> DataFrame:
    spark.dataSource.register(TreeSource)
    reader = spark.read.format("source_tree").option("path", path)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def decode_text(data: bytes | None) -> str | None:
    """UTF-8, then UTF-16 if it has a mark, then Latin-1, which reads anything."""
    if data is None:
        return None
    for encoding in ("utf-8", *(["utf-16"] if data[:2] in (b"\xff\xfe", b"\xfe\xff") else []), "latin-1"):
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            pass
    return data.decode("utf-8", "replace")


def with_text(files: DataFrame, content: str = "content") -> DataFrame:
    """Adds raw_content. Valid UTF-8 is decoded in the JVM; only the rest goes through Python."""
    utf8 = F.try_validate_utf8(F.col(content).cast("string"))

    @F.pandas_udf("string")
    def other(data):  # a pandas Series of bytes
        return data.map(decode_text)

    good = files.withColumn("raw_content", utf8)
    ok = good.where(F.col("raw_content").isNotNull() | F.col(content).isNull())
    rest = good.where(F.col("raw_content").isNull() & F.col(content).isNotNull()).withColumn("raw_content", other(F.col(content)))
    return ok.unionByName(rest)


def archive_id(path: str) -> str:
    """Stable id of a local directory: its name and the beginning of a hash of its path."""
    return f"archive_{os.path.basename(os.path.normpath(path))}_{hashlib.md5(path.encode()).hexdigest()[:8]}"


def concatenated(files: DataFrame, most_bytes: int = 256 * 1024) -> DataFrame:
    """(repo_id, file_path, file_id, text): the parts of every repository's context, files within the size limit in order of their paths, each under a heading.

    Parts are range-partitioned and sorted, so written files hold them in order, and a repository of any size is many parts and never one row.
    """
    part = F.concat(F.lit("=== "), "file_path", F.lit(" ===\n"), "raw_content")
    small = files.where((F.octet_length("raw_content") <= most_bytes) & F.col("raw_content").isNotNull())
    return small.select("repo_id", "file_path", "file_id", part.alias("text")).repartitionByRange("repo_id", "file_path", "file_id").sortWithinPartitions("repo_id", "file_path", "file_id")


def context_sizes(files: DataFrame, most_bytes: int = 256 * 1024) -> DataFrame:
    """(repo_id, n_files, n_chars): length of every repository's context with a line end between its parts; no text is moved."""
    small = files.where((F.octet_length("raw_content") <= most_bytes) & F.col("raw_content").isNotNull())
    heading = F.length("file_path") + F.lit(len("===  ===\n"))
    return small.groupBy("repo_id").agg(F.count("*").alias("n_files"), (F.sum(heading + F.length("raw_content")) + F.count("*") - 1).cast("bigint").alias("n_chars"))


def extension_histogram(files: DataFrame) -> DataFrame:
    from quillon.functions.paths import suffix

    return files.groupBy(suffix(F.col("file_path")).alias("ext")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- blame output

_BLAME = "repo_id string, file_path string, commit string, author string, email string, line_no int"


def parse_porcelain(text: str) -> Iterator[tuple[str, str | None, str | None, int]]:
    """(commit, author, email, line) per line of ``git blame --line-porcelain`` output."""
    import re

    commit, line, author, email = None, 0, None, None
    for row in text.split("\n"):
        m = re.match(r"^([0-9a-f]{40}) \d+ (\d+)", row)
        if m:
            commit, line, author, email = m[1], int(m[2]), None, None
        elif row.startswith("author "):
            author = row[7:].strip() or None
        elif row.startswith("author-mail "):
            email = row[12:].strip().strip("<>") or None
        elif row.startswith("\t") and commit:
            yield commit, author, email, line


def blame_lines(raw: DataFrame) -> DataFrame:
    """Rows per line of (repo_id, file_path, porcelain)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _BLAME.split(", ")]
        types = [*[pa.string()] * 5, pa.int32()]
        for b in batches:
            rows = [(r, p, *x) for r, p, t in zip(*(c.to_pylist() for c in b.columns)) for x in parse_porcelain(t or "")]
            cols = list(zip(*rows)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    return raw.select("repo_id", "file_path", "porcelain").mapInArrow(run, _BLAME)


def blame_counts(lines: DataFrame) -> DataFrame:
    return lines.groupBy("repo_id", "file_path", "email").agg(F.count("*").alias("line_count"))


def repo_id_from_url(url: Column) -> Column:
    """owner_name of a repository address, cleaned; owners are cut at 40 characters if the whole is longer than 100."""
    owner = F.regexp_extract(url, r"github\.com[/:]([^/]+)/([^/\s]+?)(?:\.git)?/?$", 1)
    name = F.regexp_extract(url, r"github\.com[/:]([^/]+)/([^/\s]+?)(?:\.git)?/?$", 2)
    clean = lambda c: F.regexp_replace(c, r"[^A-Za-z0-9_-]", "-")
    full = F.concat_ws("_", clean(owner), clean(name))
    short = F.concat_ws("_", F.substring(clean(owner), 1, 40), F.substring(clean(name), 1, 59))
    return F.when(owner == "", F.lit(None)).when(F.length(full) > 100, short).otherwise(full)

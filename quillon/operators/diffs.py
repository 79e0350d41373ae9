"""Changed lines against code spans."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_HUNK = re.compile(r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@", re.M)
_OUT = "diff_id string, file_path string, status string, added int, removed int, hunk int, start int, len int"


def parse(diff: str) -> list[tuple]:
    """(path, status, added, removed, [(start, length)...]) per file; a later section for a path replaces an earlier one."""
    out: dict[str, tuple] = {}
    for section in re.split(r"(?m)^diff --git ", diff)[1:]:
        old = re.search(r"(?m)^--- (?:a/)?(.+?)\r?$", section)
        new = re.search(r"(?m)^\+\+\+ (?:b/)?(.+?)\r?$", section)
        renamed = re.search(r"(?m)^rename to (.+?)\r?$", section)
        path = new[1] if new and new[1] != "/dev/null" else old[1] if old and old[1] != "/dev/null" else renamed[1] if renamed else None
        if path is None:
            continue
        status = "deleted" if new and new[1] == "/dev/null" else "added" if old and old[1] == "/dev/null" or "\nnew file mode" in section else "renamed" if renamed else "modified"
        lines = section.split("\n")
        added = sum(x.startswith("+") and not x.startswith("++") for x in lines)
        removed = sum(x.startswith("-") and not x.startswith("--") for x in lines)
        hunks = [(int(m[1]), int(m[2]) if m[2] is not None else 1) for m in _HUNK.finditer(section)]
        out[path] = (path, status, added, removed, hunks)
    return list(out.values())


def hunks(diffs: DataFrame) -> DataFrame:
    """One row per hunk (files without hunks one row with nulls) of (diff_id, diff_text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _OUT.split(", ")]
        types = [pa.string(), pa.string(), pa.string(), *[pa.int32()] * 5]
        for b in batches:
            rows = []
            for did, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for path, status, added, removed, found in parse(text or ""):
                    rows += [(did, path, status, added, removed, i, s, n) for i, (s, n) in enumerate(found)] or [(did, path, status, added, removed, None, None, None)]
            cols = list(zip(*rows)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    return diffs.select(F.col("diff_id").cast("string").alias("diff_id"), "diff_text").mapInArrow(run, _OUT)


def valid_diff(text):
    """Column: whether a text looks like a diff."""
    return text.rlike(r"(?m)^diff --git |^@@ -\d+|^--- |^\+\+\+ ")


def touched_spans(changes: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """Spans that a hunk overlaps: equal keys and overlapping intervals; a hunk of length 0 touches nothing."""
    h = changes.where("len > 0")
    join = h.join(spans, keys).where((F.col("start") <= F.col("end_line")) & (F.col("start_line") <= F.col("start") + F.col("len") - 1))
    return join.select(*keys, "span_id").distinct()


def routed(changes: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """All spans of new and deleted files, overlapping spans of the others, with how they changed."""
    whole = changes.where(F.col("status").isin("added", "deleted")).select(*keys, "status").distinct()
    all_of = spans.join(whole, keys).select(*keys, "span_id", F.col("status").alias("change"))
    part = touched_spans(changes.where(~F.col("status").isin("added", "deleted")), spans, keys).withColumn("change", F.lit("modified"))
    return all_of.unionByName(part)


def unknown_files(changes: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    return changes.select(*keys).distinct().join(spans, keys, "left_anti")


def totals(changes: DataFrame) -> DataFrame:
    """(diff_id, n_files, added, removed, n_new, n_deleted, summary)."""
    per = changes.select("diff_id", "file_path", "status", "added", "removed").distinct()
    agg = per.groupBy("diff_id").agg(F.count("*").alias("n_files"), F.sum("added").alias("added"), F.sum("removed").alias("removed"), F.count_if(F.col("status") == "added").alias("n_new"), F.count_if(F.col("status") == "deleted").alias("n_deleted"))
    text = F.format_string("%d file%s changed, %d added and %d removed line%s", "n_files", F.when(F.col("n_files") == 1, "").otherwise("s"), "added", "removed", F.when(F.col("removed") == 1, "").otherwise("s"))
    return agg.withColumn("summary", text)


def checked_spans(spans: DataFrame) -> DataFrame:
    """Spans whose start is after their end stop the query."""
    return spans.withColumn("start_line", F.when(F.col("start_line") > F.col("end_line"), F.raise_error(F.lit("span starts after its end"))).otherwise(F.col("start_line")))


def span_problems(spans: DataFrame) -> DataFrame:
    """Spans whose place is missing or runs backwards, with the problem."""
    problem = F.when(F.col("start_line").isNull() | F.col("end_line").isNull(), "missing").when(F.col("start_line") > F.col("end_line"), "backwards")
    return spans.withColumn("problem", problem).where("problem is not null")

"""Finding and changing blocks of source text."""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _python_block(text: str, name: str) -> tuple[int, int] | None:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return None
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) and node.name == name:
            first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
            return first, node.end_lineno or node.lineno
    return None


def find_block(text: str, name: str, language: str) -> tuple[int, int] | None:
    """(first line, last line) of a named block: by syntax in Python, by heading in Markdown, by braces elsewhere."""
    lines = text.split("\n")
    if language == "python":
        return _python_block(text, name)
    if language == "markdown":
        for i, line in enumerate(lines):
            m = re.match(r"^(#+)\s+(.*?)\s*#*$", line)
            if m and m[2] == name:
                end = next((j for j in range(i + 1, len(lines)) if (h := re.match(r"^(#+)\s", lines[j])) and len(h[1]) <= len(m[1])), len(lines))
                return i + 1, end
        return None
    opener = re.compile(rf"\b(?:function|func|fn|class|struct|interface|enum|trait|impl|type|const|let|var|public|private|protected|static|void|int|auto)\b[^;{{]*\b{re.escape(name)}\b[^;]*")
    for i, line in enumerate(lines):
        if opener.match(line.strip()):
            depth, seen = 0, False
            for j in range(i, len(lines)):
                depth += lines[j].count("{") - lines[j].count("}")
                seen = seen or "{" in lines[j]
                if seen and depth <= 0:
                    return i + 1, j + 1
            return None
    return None


def apply_ops(text: str, ops: list[tuple[str, str | None, str | None]], language: str) -> tuple[str, list[str]]:
    """Folds (operation, target, content) over a text in order; each gives ok or an error, and an error changes nothing."""
    report = []
    for operation, target, content in ops:
        content = content or ""
        if operation == "CREATE_FILE":
            text = content
            report.append("ok")
        elif operation in ("REPLACE_BLOCK", "ADD_FIELD_TO_STRUCT") and target:
            span = find_block(text, target, language)
            if span is None:
                report.append(f"error: {target} not found")
                continue
            lines = text.split("\n")
            if operation == "REPLACE_BLOCK":
                lines[span[0] - 1 : span[1]] = content.split("\n")
            elif language not in ("rust", "go", "cpp"):
                report.append("error: no struct in this language")
                continue
            else:
                lines[span[1] - 1 : span[1] - 1] = ["    " + content]
            text = "\n".join(lines)
            report.append("ok")
        else:
            report.append("error: unknown operation" if target or operation not in ("REPLACE_BLOCK", "ADD_FIELD_TO_STRUCT") else "error: no target")
    return text, report


def apply_plan(files: DataFrame, ops: DataFrame) -> DataFrame:
    """(file_path, new_text, n_ok, n_failed, report) of every file that operations name, in the order of seq.

    ``files`` has file_path, language and text; ``ops`` has seq, operation, file_path, target_identifier and content. A plan for one file is small.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("seq")
        first = frame.iloc[0]
        rows = [tuple(None if pd.isna(v) else v for v in r) for r in frame[["operation", "target_identifier", "content"]].itertuples(index=False)]
        text, report = apply_ops(first["text"] if isinstance(first["text"], str) else "", rows, first["language"] if isinstance(first["language"], str) else "unknown")
        ok = sum(x == "ok" for x in report)
        return pd.DataFrame([{"file_path": first["file_path"], "new_text": text, "n_ok": ok, "n_failed": len(report) - ok, "report": "; ".join(report)}])

    joined = ops.join(files, "file_path", "left").select("file_path", "seq", "operation", "target_identifier", "content", "language", "text")
    return joined.groupBy("file_path").applyInPandas(run, "file_path string, new_text string, n_ok int, n_failed int, report string")


#: The fields that each operation needs.
OPERATIONS = {"CREATE_FILE": ["file_path", "content"], "REPLACE_BLOCK": ["file_path", "target_identifier", "content"], "ADD_FIELD_TO_STRUCT": ["file_path", "target_identifier", "content"]}


def checked_plan(ops: DataFrame) -> DataFrame:
    """Adds problems: an unknown operation, or the fields that it lacks."""
    need = F.create_map(*[x for k, v in OPERATIONS.items() for x in (F.lit(k), F.array(*[F.lit(f) for f in v]))])
    have = F.array_compact(F.array(*[F.when(F.coalesce(F.col(c), F.lit("")) != "", F.lit(c)) for c in ("file_path", "target_identifier", "content")]))
    lacking = F.array_except(need[F.col("operation")], have)
    return ops.withColumn("problems", F.when(~F.col("operation").isin(*OPERATIONS), F.array(F.lit("unknown operation"))).otherwise(lacking))


def documented(text: str) -> tuple[int, int]:
    """(functions and classes, those with a docstring) of a Python text; (0, 0) if it does not parse."""
    try:
        tree = ast.parse(text or "")
    except (SyntaxError, ValueError, RecursionError):
        return 0, 0
    nodes = [n for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))]
    return len(nodes), sum(ast.get_docstring(n) is not None for n in nodes)


def valid_test(text: str) -> bool:
    """Whether a generated test parses and defines a test; it is never run."""
    try:
        tree = ast.parse(text or "")
    except (SyntaxError, ValueError, RecursionError):
        return False
    return any(isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) and n.name.startswith("test_") for n in ast.walk(tree))


def doc_coverage(files: DataFrame) -> DataFrame:
    """(repo_id, n_definitions, n_documented, coverage) over Python files."""
    from quillon.functions import paths

    @F.pandas_udf("n int, d int")
    def count(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([documented(t) for t in texts], columns=["n", "d"])

    c = files.where((paths.language(F.col("file_path")) == "python") & F.col("raw_content").isNotNull()).select("repo_id", count("raw_content").alias("c"))
    agg = c.groupBy("repo_id").agg(F.sum("c.n").alias("n_definitions"), F.sum("c.d").alias("n_documented"))
    return agg.withColumn("coverage", F.round(F.when(F.col("n_definitions") > 0, F.col("n_documented") / F.col("n_definitions")).otherwise(0.0), 4))


# What stands between the parts that are kept of a text.
_AFTER_IMPORTS, _BETWEEN = "\n... # (Code imports)\n", "\n\n... # (Code omitted for brevity)\n\n"


def relevant_code(text: str | None, keywords: list[str] | None, path: str | None) -> str:
    """The part of a text that a report's keywords name: in Python its imports and the functions and classes of those names, elsewhere the lines that hold one. The whole text where nothing is named or it does not parse."""
    text, wanted = text or "", set(keywords or ())
    if not text or not wanted:
        return text
    if not (path or "").endswith(".py"):
        return "\n".join(x for x in text.splitlines() if any(k in x for k in wanted)) or text
    try:
        nodes = list(ast.walk(ast.parse(text)))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return text
    cut = lambda n: ast.get_source_segment(text, n) or ""
    named = sorted((n for n in nodes if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) and n.name in wanted), key=lambda n: n.lineno)
    if not named:
        return text
    imports = [cut(n) for n in nodes if isinstance(n, (ast.Import, ast.ImportFrom))]
    parts = [*imports, *([_AFTER_IMPORTS] if imports else []), *dict.fromkeys(map(cut, named))]
    return _BETWEEN.join(filter(None, parts))


def compressed(files: DataFrame, keywords: list[str]) -> DataFrame:
    """Adds relevant, the part of raw_content that the keywords of one report name."""

    @F.pandas_udf("string")
    def keep(texts: pd.Series, where: pd.Series) -> pd.Series:
        return pd.Series([relevant_code(t, keywords, p) for t, p in zip(texts, where)], dtype=object)

    return files.withColumn("relevant", keep("raw_content", "file_path"))


def with_docstring(code, docstring):
    """Column: the code with a docstring behind the first line that opens a function or class; unchanged without one. The docstring is set in by four more blanks than that line."""
    head = r"(?m)^(\s*)(?:def|class)\s+\w+"
    opener, indent = F.regexp_extract(code, head, 0), F.regexp_extract(code, head, 1)
    put = F.concat(opener, F.lit("\n"), indent, F.lit('    \"\"\"'), docstring, F.lit('\"\"\"'))
    at = F.instr(code, opener) if isinstance(opener, str) else F.call_function("instr", code, opener)
    return F.when(opener == "", code).otherwise(F.concat(F.substring(code, F.lit(1), at - 1), put, F.substring(code, at + F.length(opener), F.length(code))))

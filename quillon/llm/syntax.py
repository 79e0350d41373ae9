"""Source files that do not parse (problem 4).

Method: the languages are ranked for each text by their tokens. A text is parsed by the grammar of its stated language; if that
fails, by every other grammar in the order of the ranking. A success in another language means a wrong extension, failure in all means corruption.

Defined results: the language is detected_language without regard to case, if null that of the extension; languages without a
grammar (``unknown``) are never judged. Null and empty texts parse. Each row is judged by itself, so repeated rows repeat their result;
a null path and null language gives ``unknown``. Extra columns are ignored.

Scale: no shuffle for the flags; rates shuffle only (repository, language) counts, combined map-side. Rows without a
grammar are settled in the JVM and their texts never reach Python.
"""

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.grammars import LANGUAGES, parses

#: Language of each extension (fixed values).
EXTENSIONS = {
    "py": "python", "pyi": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java", "go": "go",
    "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "h": "cpp", "hpp": "cpp", "c": "cpp", "rs": "rust", "rb": "ruby", "php": "php",
}

_SIGNS = {
    "python": r"^\s*(?:def \w+\(.*\)(?: ->.*)?:|class \w+.*:|from [\w.]+ import|import [\w.]+$|elif .*:|if .*:$|self\.)", "javascript": r"\b(?:const|let) \w+ =|function \w*\(|===|=> ?\{|require\(", "typescript": r": (?:string|number|unknown|any|boolean)\b|^export |interface \w+ \{",
    "java": r"^package [\w.]+;|^import [\w.]+;|\bpublic (?:class|static|\w+ \w+\()|\bprivate \w+", "go": r"^package \w+$|^func |:=|^import \(", "cpp": r"^#include|\bstd::|\bauto \w+ =|^int \w+\(", "rust": r"\bfn \w+\(|\blet (?:mut )?\w+|^use \w+::|-> \w+ \{",
    "ruby": r"^\s*(?:def \w+[^:{]*$|end$|module [A-Z]|require_relative|\w+\.each do)", "php": r"<\?php|\$\w+ =|\$\w+->",
}
_SIGN_RES = {k: re.compile(v, re.M) for k, v in _SIGNS.items()}


def rank(text: str) -> list[str]:
    """Languages by how much of the text looks like them, most likely first."""
    scores = {k: len(r.findall(text)) for k, r in _SIGN_RES.items()}
    return sorted(LANGUAGES, key=lambda k: (-scores[k], k))


def judge(text: str | None, language: str) -> tuple[bool, str | None, str]:
    """(does not parse, language it does parse as, ok | wrong_extension | corrupt)."""
    if not text or parses(text, language):
        return False, language, "ok"
    for other in rank(text):
        if other != language and parses(text, other):
            return True, other, "wrong_extension"
    return True, None, "corrupt"


def language_of(language="detected_language", path="file_path"):
    """Column: the stated language in lower case, else that of the extension, else unknown."""
    ext = F.lower(F.regexp_extract(F.coalesce(F.col(path), F.lit("")), r"\.([^./]+)$", 1))
    table = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    return F.coalesce(F.lower(F.col(language)), table[ext], F.lit("unknown"))


_OUT = "file_id bigint, repo_id string, language string, broken boolean, parsed_as string, verdict string"


def check(files: DataFrame) -> DataFrame:
    """(file_id, repo_id, language, broken, parsed_as, verdict) for every row."""
    base = files.select(F.col("file_id").cast("bigint").alias("file_id"), "repo_id", language_of().alias("language"), "raw_content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [judge(t, lang) for lang, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            cols = list(zip(*got)) if got else [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(cols[0], pa.bool_()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())],
                ["file_id", "repo_id", "language", "broken", "parsed_as", "verdict"],
            )

    known = F.col("language").isin(*LANGUAGES)
    rest = base.where(~known).select("file_id", "repo_id", "language", F.lit(False).alias("broken"), F.lit(None).cast("string").alias("parsed_as"), F.lit("unjudged").alias("verdict"))
    return base.where(known).mapInArrow(run, _OUT).unionByName(rest)


def rates(checked: DataFrame) -> DataFrame:
    """Files, broken files and the rate per repository and language."""
    return checked.groupBy("repo_id", "language").agg(
        F.count("*").alias("n_files"), F.count_if("broken").alias("n_broken"), F.count_if(F.col("verdict") == "wrong_extension").alias("n_wrong_extension"), F.round(F.avg(F.col("broken").cast("int")), 6).alias("rate")
    )


def found(files: DataFrame) -> DataFrame:
    return check(files).where("broken").select("file_id").distinct()

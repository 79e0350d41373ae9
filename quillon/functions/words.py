"""Column functions over questions, reports, names and addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions import paths

# Words that tell what a question asks for, extensions that tell a file's name, purposes of directories.
QUESTION_WORDS = ["what", "how", "where", "when", "why", "which"]
ACTION_WORDS = ["implement", "use", "call", "create", "update", "delete"]
NAMED_FILE = r"(?:\s|-|\*|`)([\w./-]+\.(?:py|js|ts|gs|json|md|html|css|yaml|yml|toml|txt))\b"
TICKED_FILE = r"`([\w./\\-]+)`"
DIRECTORY_PURPOSES = {
    "src": "source code",
    "app": "application code",
    "api": "API endpoints",
    "models": "data models",
    "views": "view components/templates",
    "controllers": "controllers",
    "services": "business logic services",
    "components": "reusable components",
    "utils": "utility functions",
    "helpers": "helper functions",
    "tests": "test files",
    "config": "configuration files",
    "static": "static assets",
    "templates": "template files",
    "migrations": "database migrations",
}
TICKED, CALLED, NAMED = r"`([^`]+)`", r"\b([a-zA-Z_][a-zA-Z0-9_]*)\s*\(", r"\b([A-Z][a-z]+(?:[A-Z][a-z]+)*|[a-z]+(?:_[a-z]+)+)\b"


def question_marks(question: Column) -> Column:
    """The question and action words that stand in a question, also within other words, in their order."""
    low = F.lower(question)
    return F.filter(F.array(*[F.lit(w) for w in (*QUESTION_WORDS, *ACTION_WORDS)]), lambda w: low.contains(w))


def report_keywords(report: Column) -> Column:
    """Sorted names of code elements in a report: in backticks, before a parenthesis, in camel or snake case; their last part, of three characters at least."""
    found = F.concat(*[F.regexp_extract_all(report, F.lit(p), 1) for p in (TICKED, CALLED, NAMED)])
    last = F.transform(found, lambda k: F.element_at(F.split(F.element_at(F.split(k, r"\."), -1), "::"), -1))
    return F.array_sort(F.array_distinct(F.filter(last, lambda k: F.length(k) > 2)))


def named_files(report: Column) -> Column:
    """Sorted names of files in a report."""
    found = F.concat(F.regexp_extract_all(report, F.lit(NAMED_FILE), 1), F.regexp_extract_all(report, F.lit(TICKED_FILE), 1))
    return F.array_sort(F.array_distinct(F.filter(found, lambda f: f.contains("."))))


def directory_purpose(name: Column) -> Column:
    return F.coalesce(paths.lit_map(DIRECTORY_PURPOSES)[F.lower(name)], F.lit("unknown purpose"))


def is_repository_url(url: Column) -> Column:
    return F.coalesce(F.regexp_replace(url, "/+$", "").rlike(r"^https://github\.com/[a-zA-Z0-9_.-]+/[a-zA-Z0-9_.-]+/?$"), F.lit(False))


def issue_of_url(url: Column) -> Column:
    """(owner, repository, number) of the address of an issue or pull request; null of any other."""
    pattern = r"^https://github\.com/([^/]+)/([^/]+)/(?:issues|pull)/(\d+)"
    part = lambda i: F.regexp_extract(url, pattern, i)
    return F.when(url.rlike(pattern), F.struct(part(1).alias("owner"), part(2).alias("repository"), part(3).cast("bigint").alias("number")))


def chunk_id(repo: Column, path: Column, pos: Column) -> Column:
    return F.concat_ws("_", repo, path, pos.cast("string"))


def chunk_path(chunk: Column, repo: Column) -> Column:
    """The path inside a chunk's id: what is left without the repository and the last part."""
    rest = F.when(F.startswith(chunk, F.concat(repo, F.lit("_"))), F.substring(chunk, F.length(repo) + 2, F.length(chunk))).otherwise(chunk)
    return F.regexp_replace(rest, "_[^_]*$", "")


def stored_repo_id(stated: Column, path: Column) -> Column:
    """The id that a document states, else of its file's name without ``_cortex``, else its directory's name, else the file's name."""
    name = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")
    parent = F.regexp_extract(path, r"([^/]*)/[^/]*$", 1)
    cut = F.when(name.endswith("_cortex"), F.nullif(F.regexp_replace(name, "_cortex$", ""), F.lit("")))
    folder = F.when(~parent.isin("", "cloned_repositories"), parent)
    return F.coalesce(F.nullif(stated, F.lit("")), cut, folder, F.nullif(F.replace(name, F.lit("_cortex"), F.lit("")), F.lit("")), F.lit("unknown_repo"))


def learning_objective(path: Column, summary: Column) -> Column:
    """What a file's summary says that there is to learn: service, model, request handling, helpers or purpose."""
    low = F.lower(summary)
    return F.when(low.contains("service"), "service").when(low.contains("model"), "model").when(low.contains("controller") | low.contains("view"), "handling").when(low.contains("util") | low.contains("helper"), "helpers").otherwise("purpose")


def closeness(a: Column, b: Column) -> Column:
    """How alike two short names are, from 0 to 100: by the edits that turn one into the other."""
    most = F.greatest(F.length(a), F.length(b))
    return F.when(most == 0, 0.0).otherwise(F.round(100 * (1 - F.levenshtein(a, b) / most), 4))

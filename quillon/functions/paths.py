"""Column functions over file paths."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions import lookup


def lit_map(table: dict[str, str]) -> Column:
    """A constant map column."""
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def suffix(path: Column) -> Column:
    """Lower-cased last extension with its dot; '' for none, for dotfiles and for a trailing dot."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*(\.[^./]+)$", 1))


def stem(path: Column) -> Column:
    name = basename(path)
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")


def language(path: Column) -> Column:
    """Language of the extension, else ``unknown``."""
    return F.coalesce(lit_map(lookup.LANGUAGE_BY_EXTENSION)[suffix(path)], F.lit("unknown"))


def display_language(path: Column) -> Column:
    """Display name of the extension's language; a second map, different from :func:`language`."""
    ext = F.when(suffix(path) == "", F.lit("no_extension")).otherwise(suffix(path))
    return F.coalesce(lit_map(lookup.DISPLAY_BY_EXTENSION)[ext], F.format_string("Unknown (%s)", ext))


def contains_any(text: Column, marks: list[str]) -> Column:
    out = F.lit(False)
    for m in marks:
        out = out | text.contains(m)
    return out


def category(path: Column) -> Column:
    """Test marks, then file names, then extensions, else ``other``."""
    low = F.lower(path)
    return (
        F.when(F.coalesce(low, F.lit("")) == "", "other")
        .when(contains_any(low, lookup.TEST_MARKS), "testing")
        .otherwise(F.coalesce(lit_map(lookup.CATEGORY_BY_NAME)[basename(low)], lit_map(lookup.CATEGORY_BY_EXTENSION)[suffix(path)], F.lit("other")))
    )


def glob_to_regex(glob: str) -> str:
    """A shell pattern (``*`` crosses ``/``) as an anchored regular expression."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and "]" in glob[i + 1 :]:
            j = glob.index("]", i + 1)
            body = glob[i + 1 : j]
            out += "[" + ("^" + body[1:] if body.startswith("!") else body).replace("\\", "\\\\") + "]"
            i = j
        else:
            out += re.escape(c)
        i += 1
    return f"^(?s:{out})$"


def matches_pattern(path: Column, pattern: str) -> Column:
    """Directory patterns (``dir/``) match as prefix or inside, ``*.ext`` as suffix, others as globs."""
    if pattern.endswith("/"):
        return path.startswith(pattern) | path.contains("/" + pattern)
    if pattern.startswith("*.") and not set("*?[") & set(pattern[1:]):
        return path.endswith(pattern[1:])
    return path.rlike(glob_to_regex(pattern))


def safe_path(path: Column) -> Column:
    """No parent steps, absolute paths or backslashes."""
    return ~(path.contains("..") | path.startswith("/") | path.contains("\\"))


def hidden(path: Column) -> Column:
    return F.exists(F.split(path, "/"), lambda p: p.startswith(".") & ~p.isin(".", ".."))


def in_excluded_directory(path: Column, names: list[str] = lookup.EXCLUDED_DIRECTORIES) -> Column:
    parts = F.split(path, "/")
    return F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*[F.lit(n) for n in names]))

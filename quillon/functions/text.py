"""Column functions over texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def token_count(text: Column) -> Column:
    """Runs without Unicode white space; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"(?U)\S+")), F.lit(0))


def line_count(text: Column) -> Column:
    """Lines that end at ``\\n``; a last line without an end counts, an empty text has none."""
    n = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0).otherwise(n + F.when(F.endswith(text, F.lit("\n")), 0).otherwise(1))


def occurrences(text: Column, part: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def token_set(text: Column) -> Column:
    """Distinct lower-cased tokens."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda t: t != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def overlap(a: Column, b: Column) -> Column:
    """Shared part of the smaller set; 0 if either is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / least)


def snake_case(name: Column) -> Column:
    once = F.regexp_replace(name, r"(.)([A-Z][a-z]+)", "$1_$2")
    return F.lower(F.regexp_replace(once, r"([a-z0-9])([A-Z])", "$1_$2"))


def camel_case(name: Column) -> Column:
    return F.array_join(F.transform(F.split(name, "_"), lambda p: F.initcap(p)), "")


def name_from_email(email: Column) -> Column:
    """Local part in words with capitals."""
    return F.initcap(F.trim(F.regexp_replace(F.split(email, "@")[0], r"[._\- ]+", " ")))


def path_template(path: Column) -> Column:
    """``<str:id>`` and ``<id>`` as ``{id}``."""
    return F.regexp_replace(path, r"<(?:str:)?(\w+)>", r"{$1}")


def branch_name(title: Column, limit: int = 60) -> Column:
    clean = F.regexp_replace(F.lower(title), r"[^a-z0-9\s-]", "")
    return F.substring(F.regexp_replace(F.trim(clean), r"\s+", "-"), 1, limit)


def strip_fences(text: Column) -> Column:
    """Without a leading and trailing code fence."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[\w]*\s*\n?", ""), r"\n?```$", ""))


def context_window(text: Column, needle: Column | str, around: int = 50) -> Column:
    """Text around the first occurrence; empty if there is none."""
    what = F.lit(needle) if isinstance(needle, str) else needle
    at = F.call_function("locate", what, text)
    start = F.greatest(at - around, F.lit(1))
    return F.when(at > 0, F.substring(text, start, at - start + F.length(what) + around)).otherwise("")


def version_core(version: Column) -> Column:
    """Without range operators; null for blank or ``any``."""
    bare = F.trim(F.regexp_replace(version, r"[\^~><=!]+", ""))
    return F.when(~F.lower(bare).isin("", "any"), bare)


def embedded_json(text: Column) -> Column:
    """The fenced or outermost JSON array or object in a text, thinking blocks left out; null if there is none."""
    bare = F.regexp_replace(text, r"(?s)<think>.*?</think>", "")
    fenced = F.regexp_extract(bare, r"(?s)```(?:json)?\s*([\[{].*?[\]}])\s*```", 1)
    outer = F.regexp_extract(bare, r"(?s)([\[{].*[\]}])", 1)
    return F.nullif(F.when(fenced != "", fenced).otherwise(outer), F.lit(""))

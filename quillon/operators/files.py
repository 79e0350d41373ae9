"""Classification and measurement of source files: one row in, one row out, all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import lookup, paths
from quillon.functions.text import line_count, occurrences


def latest(files: DataFrame) -> DataFrame:
    """The last crawl of every (repo_id, ref, file_path); ties go to the larger file_id."""
    best = files.groupBy("repo_id", "ref", "file_path").agg(F.max_by("file_id", F.struct("crawled_at", "file_id")).alias("file_id"))
    return files.join(best.select("file_id"), "file_id", "left_semi")


def classified(files: DataFrame) -> DataFrame:
    """Adds ext, language, display_language, category, is_test, is_doc, n_lines."""
    p = F.col("file_path")
    return files.withColumns({
        "ext": paths.suffix(p), "language": paths.language(p), "display_language": paths.display_language(p), "category": paths.category(p),
        "is_test": is_test(p), "is_doc": is_doc(p), "n_lines": line_count(F.col("raw_content")),
    })


def is_test(path: Column) -> Column:
    return F.lower(path).contains("test") | F.lower(path).contains("spec")


def is_doc(path: Column) -> Column:
    return F.lower(path).rlike("readme|doc|changelog|contributing")


def scan_filter(files: DataFrame, globs: list[str], excluded: list[str] = lookup.EXCLUDED_DIRECTORIES, include_hidden: bool = False, special: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose path matches any glob, outside the excluded directories; hidden parts only for special names."""
    p = F.col("file_path")
    keep = F.lit(False)
    for g in globs:
        keep = keep | paths.basename(p).rlike(paths.glob_to_regex(g))
    out = files.where(keep & ~paths.in_excluded_directory(p, excluded))
    return out if include_hidden else out.where(~paths.hidden(p) | paths.basename(p).isin(*special))


def marks_found(text: Column, table: dict[str, list[str]]) -> Column:
    """Names of the entries any of whose marks stands in the text, in the table's order."""
    return F.array_compact(F.array(*[F.when(paths.contains_any(text, marks), F.lit(name)) for name, marks in table.items()]))


def _lower_once(text: Column, make) -> Column:
    """An expression over the lower-cased text, which is made once per row however often it is used."""
    return F.transform(F.array(F.lower(text)), make)[0]


def frameworks(text: Column) -> Column:
    return _lower_once(text, lambda low: marks_found(low, lookup.FRAMEWORK_MARKS))


def framework_signatures(text: Column) -> Column:
    return _lower_once(text, lambda low: marks_found(low, lookup.FRAMEWORK_SIGNATURES))


def smells(text: Column, language: Column) -> Column:
    """Signs of poor quality, as an array of names in a fixed order."""
    n = line_count(text)
    lines = F.split(text, "\n")
    long_lines = F.size(F.filter(lines, lambda x: F.length(F.trim(x)) > 100))
    js = language.isin("javascript", "typescript")
    checks = [
        (n > 1000, "very_large_file"), (F.length(text) > 100_000, "large_file_size"),
        ((language == "python") & text.contains("import *"), "wildcard_import"), ((language == "python") & (occurrences(text, "except:") > occurrences(text, "except ")), "bare_except"),
        ((language == "python") & (long_lines > n * 0.1), "long_lines"), (js & text.contains("eval("), "eval_usage"),
        (js & (occurrences(text, "var ") > occurrences(text, "let ") + occurrences(text, "const ")), "var_over_let_const"),
        ((language == "java") & (occurrences(text, "public class") > 1), "multiple_public_classes"), ((language == "java") & text.contains("System.out.print"), "system_out_usage"),
    ]
    first = F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in checks]))
    exposed = _lower_once(text, lambda low: F.array_compact(F.array(*[F.when(low.contains(w), F.lit(f"potential_{w}_exposure")) for w in lookup.SECURITY_WORDS])))
    return F.concat(first, F.coalesce(exposed, F.array().cast("array<string>")))


def ast_summary(chunks: DataFrame) -> DataFrame:
    """(file_id, total_chunks, chunk_types as JSON, n_named) from the chunks of each file."""
    per = chunks.groupBy("file_id", F.coalesce("chunk_type", F.lit("unknown")).alias("t")).agg(F.count("*").alias("n"), F.count("name").alias("named"))
    types = F.map_from_entries(F.array_sort(F.collect_list(F.struct("t", "n"))))
    return per.groupBy("file_id").agg(F.sum("n").alias("total_chunks"), F.to_json(types).alias("chunk_types"), F.sum("named").alias("n_named"))


def find_by_name(files: DataFrame, name: str) -> DataFrame:
    """(status, file_path, options) per repository: found if unique or unique at the root, ambiguous otherwise."""
    p = F.col("file_path")
    hits = files.where((paths.basename(p) == name) | p.endswith("/" + name)).select("repo_id", "file_path").distinct()
    per = hits.groupBy("repo_id").agg(F.array_sort(F.collect_set("file_path")).alias("options"), F.max(F.when(~p.contains("/"), p)).alias("root"))
    one = F.size("options") == 1
    return per.select(
        "repo_id", F.when(one | F.col("root").isNotNull(), "found").otherwise("ambiguous").alias("status"),
        F.when(one, F.element_at("options", 1)).otherwise(F.col("root")).alias("file_path"), F.size("options").alias("n_options"),
    )


MAX_PROFILES = 10_000


def language_profiles(files: DataFrame, profiles: DataFrame) -> DataFrame:
    """Left join of files with a table of languages by extension (P4, M15: names, families, paradigms, features, practices, as the caller keeps them); a file of an unknown extension gets the profile of ``*``, if there is one.

    The table is kept by hand; it is broadcast after a check of its number of rows.
    """
    n = profiles.limit(MAX_PROFILES + 1).count()
    if n > MAX_PROFILES:
        raise ValueError(f"more than {MAX_PROFILES} language profiles")
    known = F.broadcast(profiles.select("ext").distinct().withColumn("_known", F.lit(True)))
    marked = files.withColumn("ext", paths.suffix(F.col("file_path"))).join(known, "ext", "left").withColumn("_key", F.when(F.col("_known"), F.col("ext")).otherwise("*"))
    return marked.drop("_known").join(F.broadcast(profiles.withColumnRenamed("ext", "_key")), "_key", "left").drop("_key")

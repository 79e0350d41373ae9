"""Statistics over the files of repositories. All are single- or two-stage aggregations with map-side combine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import lookup, paths
from quillon.functions.text import line_count
from quillon.operators import files as f

def _p() -> Column:
    return F.col("file_path")


def _t() -> Column:
    return F.col("raw_content")


def language_stats(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """(repo_id, language, file_count, total_lines, total_chunks, n_frameworks)."""
    base = files.select("file_id", "repo_id", paths.language(_p()).alias("language"), line_count(_t()).cast("bigint").alias("lines"), f.frameworks(_t()).alias("fw"))
    per_chunk = chunks.groupBy("file_id").agg(F.count("*").alias("chunks"))
    joined = base.join(per_chunk, "file_id", "left")
    # The sets of frameworks that occur together are few, so collecting them keeps this to one pass over the texts.
    used = F.size(F.array_distinct(F.flatten(F.collect_set("fw")))).cast("bigint")
    return joined.groupBy("repo_id", "language").agg(F.count("*").alias("file_count"), F.sum("lines").alias("total_lines"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("total_chunks"), used.alias("n_frameworks"))


def polyglot_summary(per_language: DataFrame) -> DataFrame:
    """(repo_id, total_languages, primary_language, total_files, total_lines); ties go to the first name."""
    return per_language.groupBy("repo_id").agg(
        F.count("*").alias("total_languages"), F.min_by("language", F.struct(-F.col("file_count"), "language")).alias("primary_language"),
        F.sum("file_count").alias("total_files"), F.sum("total_lines").alias("total_lines"),
    )


def display_stats(files: DataFrame) -> DataFrame:
    """(language, file_count, extensions, first_path)."""
    base = files.select(paths.display_language(_p()).alias("language"), paths.suffix(_p()).alias("ext"), "file_path")
    return base.groupBy("language").agg(F.count("*").alias("file_count"), F.countDistinct("ext").alias("n_extensions"), F.min("file_path").alias("first_path"))


def directory_stats(files: DataFrame) -> DataFrame:
    """(repo_id, n_files, size_kb, n_extensions, n_top_directories, max_depth)."""
    top = F.when(_p().contains("/"), F.split(_p(), "/")[0])
    return files.groupBy("repo_id").agg(
        F.count("*").alias("n_files"), F.round(F.sum("file_size_kb"), 4).alias("size_kb"), F.countDistinct(paths.suffix(_p())).alias("n_extensions"),
        F.countDistinct(top).alias("n_top_directories"), F.max(F.size(F.split(_p(), "/")) - 1).cast("bigint").alias("max_depth"),
    )


def health(files: DataFrame) -> DataFrame:
    """Mean of four factors: smell density, language diversity, documentation and tests."""
    base = files.select("repo_id", paths.language(_p()).alias("language"), F.size(f.smells(_t(), paths.language(_p()))).alias("n"), f.is_doc(_p()).cast("int").alias("doc"), f.is_test(_p()).cast("int").alias("test"))
    agg = base.groupBy("repo_id").agg(F.count("*").alias("files"), F.sum("n").alias("smells"), F.countDistinct("language").alias("langs"), F.sum("doc").alias("docs"), F.sum("test").alias("tests"))
    density = F.greatest(F.lit(0.0), 1 - (F.coalesce("smells", F.lit(0)) / F.col("files")) / 10)
    diversity = F.when(F.col("langs") == 1, 0.8).when(F.col("langs") <= 5, 1.0).otherwise(F.greatest(F.lit(0.5), 1 - (F.col("langs") - 5) * 0.1))
    docs = F.least(F.lit(1.0), F.col("docs") / 3)
    tests = F.least(F.lit(1.0), F.col("tests") / F.col("files") * 5)
    return agg.select("repo_id", "files", F.round((density + diversity + docs + tests) / 4, 4).alias("health"))


def languages_by_lines(files: DataFrame) -> DataFrame:
    """(repo_id, language, files, lines) of six extensions, as the dependency report counts them."""
    names = {".py": "Python", ".js": "JavaScript", ".ts": "TypeScript", ".java": "Java", ".go": "Go", ".rs": "Rust"}
    base = files.withColumn("language", paths.lit_map(names)[paths.suffix(_p())]).where("language is not null")
    return base.groupBy("repo_id", "language").agg(F.count("*").alias("files"), F.sum(line_count(_t())).cast("bigint").alias("lines"))


def _config_match(pattern: str) -> Column:
    if "*" in pattern:
        return _p().rlike("(^|/)" + pattern.replace(".", r"\.").replace("*", "[^/]*") + "$")
    return _p() == pattern


def config_counts(files: DataFrame) -> DataFrame:
    """(repo_id, kind, n): patterns with a wildcard match anywhere, plain names at the root only."""
    counts = [F.sum(sum(_config_match(p).cast("int") for p in ps)).cast("bigint").alias(kind) for kind, ps in lookup.CONFIG_PATTERNS.items()]
    wide = files.groupBy("repo_id").agg(*counts)
    return wide.unpivot("repo_id", list(lookup.CONFIG_PATTERNS), "kind", "n")


def framework_votes(files: DataFrame) -> DataFrame:
    """(repo_id, primary, hits, confidence): hits over files, which may pass 1; ties go to the first name."""
    votes = [F.sum(sum((_t().contains(i) | _p().contains(i)).cast("int") for i in marks)).cast("bigint").alias(name) for name, marks in lookup.FRAMEWORK_INDICATORS.items()]
    wide = files.groupBy("repo_id").agg(F.count("*").alias("files"), *votes)
    long = wide.unpivot(["repo_id", "files"], list(lookup.FRAMEWORK_INDICATORS), "framework", "hits").where("hits > 0")
    best = long.groupBy("repo_id").agg(F.min_by(F.struct("framework", "hits", "files"), F.struct(-F.col("hits"), "framework")).alias("b"))
    return best.select("repo_id", F.col("b.framework").alias("primary_framework"), F.col("b.hits").alias("hits"), F.round(F.col("b.hits") / F.col("b.files"), 6).alias("confidence"))


def naming(files: DataFrame) -> DataFrame:
    """(repo_id, kind, convention, n) for file, function and class names."""
    stem = paths.stem(_p())
    first = F.substring(stem, 1, 1)
    upper = lambda c: c.rlike("[A-Z]")
    file_kind = F.when(stem.contains("_") & (stem == F.lower(stem)), "snake_case").when(stem.contains("-"), "kebab_case").when(upper(first), "PascalCase").when(first.rlike("[a-z]") & upper(stem), "camelCase")
    rows = files.select("repo_id", F.lit("file").alias("kind"), file_kind.alias("convention"))
    funcs = files.select("repo_id", F.explode(F.regexp_extract_all(_t(), F.lit(r"def\s+([a-zA-Z_]\w*)"), 1)).alias("name"))
    rows = rows.unionByName(funcs.select("repo_id", F.lit("function").alias("kind"), F.when(F.col("name").contains("_"), "snake_case").when(upper(F.substring("name", 2, 10_000)), "camelCase").alias("convention")))
    classes = files.select("repo_id", F.explode(F.regexp_extract_all(_t(), F.lit(r"class\s+([a-zA-Z_]\w*)"), 1)).alias("name"))
    rows = rows.unionByName(classes.select("repo_id", F.lit("class").alias("kind"), F.when(upper(F.substring("name", 1, 1)), "PascalCase").otherwise("snake_case").alias("convention")))
    return rows.where("convention is not null").groupBy("repo_id", "kind", "convention").agg(F.count("*").alias("n"))


def top_modules(files: DataFrame, k: int = 10) -> DataFrame:
    """(repo_id, module, n, rank) of imported modules; ties by name."""
    names = files.select("repo_id", F.explode(F.regexp_extract_all(_t(), F.lit(r"(?:from|import)\s+([a-zA-Z_][\w\.]*)"), 1)).alias("module"))
    counts = names.groupBy("repo_id", "module").agg(F.count("*").alias("n"))
    order = Window.partitionBy("repo_id").orderBy(F.desc("n"), "module")
    return counts.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= k)


def testing(files: DataFrame) -> DataFrame:
    """(repo_id, n_test_files, n_test_directories, n_pytest, n_unittest, n_jest)."""
    t = files.where(f.is_test(_p()))
    has = lambda m: F.count_if(_t().contains(m))
    return t.groupBy("repo_id").agg(F.count("*").alias("n_test_files"), F.countDistinct(paths.directory(_p())).alias("n_test_directories"), has("pytest").alias("n_pytest"), has("unittest").alias("n_unittest"), has("describe(").alias("n_jest"))


def primary_by_weight(files: DataFrame) -> DataFrame:
    """(repo_id, language, files, score): the language with the largest files x weight; ties by name."""
    counts = files.groupBy("repo_id", paths.language(_p()).alias("language")).agg(F.count("*").alias("files")).where("language <> 'unknown'")
    weight = F.coalesce(paths.lit_map({k: str(v) for k, v in lookup.LANGUAGE_WEIGHTS.items()})[F.col("language")].cast("bigint"), F.lit(1).cast("bigint"))
    scored = counts.withColumn("score", F.col("files") * weight)
    best = scored.groupBy("repo_id").agg(F.min_by(F.struct("language", "files", "score"), F.struct(-F.col("score"), "language")).alias("b"))
    return best.select("repo_id", "b.language", "b.files", "b.score")


def _glob(name: str) -> str:
    return "^" + name.replace(".", r"\.").replace("*", "[^/]*") + "$"


def ecosystems(files: DataFrame) -> DataFrame:
    """(repo_id, primary_type, n_detected, build_tools): by files at the root, else by extensions anywhere; the primary one by priority, else the first of the table."""
    names = list(lookup.ECOSYSTEMS)
    path = _p()
    by_file = [F.bool_or(path.isin([x for x in roots if "*" not in x]) | (path.rlike("|".join(_glob(x) for x in roots if "*" in x) or "^$"))).alias(f"f_{n}") for n, (roots, _, _) in lookup.ECOSYSTEMS.items()]
    by_ext = [F.bool_or(path.rlike("(" + "|".join(x.replace(".", r"\.") for x in exts) + ")$")).alias(f"e_{n}") for n, (_, exts, _) in lookup.ECOSYSTEMS.items()]
    wide = files.groupBy("repo_id").agg(*by_file, *by_ext)
    any_file = F.greatest(*[F.coalesce(F.col(f"f_{n}"), F.lit(False)) for n in names])
    hit = {n: F.coalesce(F.when(any_file, F.col(f"f_{n}")).otherwise(F.col(f"e_{n}")), F.lit(False)) for n in names}
    order = [*lookup.ECOSYSTEM_PRIORITY, *(n for n in names if n not in lookup.ECOSYSTEM_PRIORITY)]
    primary = F.coalesce(*[F.when(hit[n], F.lit(n)) for n in order], F.lit("unknown"))
    tools = F.array_join(F.array_compact(F.array(*[F.when(hit[n], F.lit(",".join(lookup.ECOSYSTEMS[n][2]))) for n in names])), ",")
    return wide.select("repo_id", primary.alias("primary_type"), sum(hit[n].cast("int") for n in names).cast("bigint").alias("n_detected"), tools.alias("build_tools"))


def relationships(files: DataFrame) -> DataFrame:
    """(repo_id, n_files, n_categories, primary_category, secondary, cross_layer, complexity)."""
    distinct = files.select("repo_id", "file_path").distinct().withColumn("category", paths.category(_p()))
    counts = distinct.groupBy("repo_id", "category").agg(F.count("*").alias("n"))
    order = Window.partitionBy("repo_id").orderBy(F.desc("n"), "category")
    ranked = counts.withColumn("r", F.row_number().over(order))
    agg = ranked.groupBy("repo_id").agg(
        F.sum("n").alias("n_files"), F.count("*").alias("n_categories"), F.max(F.when(F.col("r") == 1, F.col("category"))).alias("primary_category"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("r") > 1) & (F.col("r") <= 4) & (F.col("n") > 1), F.struct("r", "category")))), lambda s: s["category"]), ",").alias("secondary"),
    )
    cross = F.col("n_categories") > 2
    level = F.when(cross & (F.col("n_files") > 15), "very_high").when((F.col("n_files") > 12) | (cross & (F.col("n_categories") > 4)), "high").when((F.col("n_files") > 6) | (F.col("n_categories") > 3), "medium").otherwise("low")
    return agg.withColumn("cross_layer", cross).withColumn("complexity", level)


def structure_tree(files: DataFrame, first: int = 20) -> DataFrame:
    """(repo_id, tree): sorted distinct paths, indented by depth, and how many more there are."""
    distinct = files.select("repo_id", "file_path").where("file_path is not null").distinct()
    order = Window.partitionBy("repo_id").orderBy("file_path")
    ranked = distinct.withColumn("r", F.row_number().over(order))
    total = distinct.groupBy("repo_id").agg(F.count("*").alias("n"))
    line = F.concat(F.expr("repeat('  ', size(split(file_path, '/')) - 1)"), paths.basename(_p()))
    shown = ranked.where(F.col("r") <= first).groupBy("repo_id").agg(F.array_sort(F.collect_list(F.struct("r", line.alias("l")))).alias("a"))
    tree = F.array_join(F.transform("a", lambda s: s["l"]), "\n")
    more = F.when(F.col("n") > first, F.concat(F.lit("\n... and "), (F.col("n") - first).cast("string"), F.lit(" more"))).otherwise("")
    return shown.join(total, "repo_id").select("repo_id", F.concat(tree, more).alias("tree"))


def snapshot(files: DataFrame) -> DataFrame:
    """(repo_id, n_test, n_impl, test_ratio): tests first, then implementation by place or extension."""
    test = F.lower(_p()).contains("test") | F.lower(_p()).contains("spec")
    impl = ~test & (_p().startswith("src/") | _p().startswith("lib/") | paths.suffix(_p()).isin(".py", ".js", ".rs", ".go"))
    agg = files.groupBy("repo_id").agg(F.count_if(test).alias("n_test"), F.count_if(impl).alias("n_impl"))
    return agg.withColumn("test_ratio", F.round(F.when(F.col("n_impl") > 0, F.col("n_test") / F.col("n_impl")).otherwise(0.0), 3))


def oracles(lang: str, show: str, category: str, ext: str, lines: str, name: str, any_sql) -> dict[str, str]:
    """SQL twins of the queries on these operators."""
    fw = " UNION ALL ".join(f"SELECT repo_id, {lang} AS language, '{n}' AS fw FROM source_files WHERE {any_sql('lower(raw_content)', m)}" for n, m in lookup.FRAMEWORK_MARKS.items())
    ls = f"""WITH c AS (SELECT file_id, count(*) AS chunks FROM chunks GROUP BY 1), fw AS ({fw}),
        m AS (SELECT repo_id, {lang} AS language, count(*) AS file_count, sum(CAST({lines} AS BIGINT)) AS total_lines, coalesce(sum(chunks), 0) AS total_chunks FROM source_files LEFT JOIN c USING (file_id) GROUP BY 1, 2),
        u AS (SELECT repo_id, language, count(DISTINCT fw) AS n_frameworks FROM fw GROUP BY 1, 2)
        SELECT repo_id, language, file_count, CAST(total_lines AS BIGINT) AS total_lines, CAST(total_chunks AS BIGINT) AS total_chunks, coalesce(n_frameworks, 0) AS n_frameworks FROM m LEFT JOIN u USING (repo_id, language)"""
    lit = lambda s: "'" + s.replace("'", "''") + "'"
    test = "contains(lower(file_path), 'test') OR contains(lower(file_path), 'spec')"
    weights = " ".join(f"WHEN '{k}' THEN {v}" for k, v in lookup.LANGUAGE_WEIGHTS.items())
    votes = " UNION ALL ".join(
        f"SELECT repo_id, '{n}' AS framework, sum({' + '.join(f'CAST(contains(coalesce(raw_content, {lit(chr(32))}), {lit(i)}) OR contains(file_path, {lit(i)}) AS INT)' for i in m)}) AS hits FROM source_files WHERE raw_content IS NOT NULL GROUP BY 1"
        for n, m in lookup.FRAMEWORK_INDICATORS.items()
    )
    config = " UNION ALL ".join(
        f"SELECT repo_id, '{k}' AS kind, CAST(sum({' + '.join(('CAST(regexp_matches(file_path, ' + lit('(^|/)' + p.replace('.', chr(92) + '.').replace('*', '[^/]*') + '$') + ') AS INT)') if '*' in p else f'CAST(file_path = {lit(p)} AS INT)' for p in ps)}) AS BIGINT) AS n FROM source_files GROUP BY 1"
        for k, ps in lookup.CONFIG_PATTERNS.items()
    )
    eco = list(lookup.ECOSYSTEMS)
    root = lambda x: f"regexp_matches(file_path, {lit(_glob(x))})" if "*" in x else f"file_path = {lit(x)}"
    flags = ", ".join(f"bool_or({' OR '.join(root(x) for x in roots)}) AS f_{n}, bool_or({' OR '.join(f'ends_with(file_path, {lit(x)})' for x in exts)}) AS e_{n}" for n, (roots, exts, _) in lookup.ECOSYSTEMS.items())
    ranked = [*lookup.ECOSYSTEM_PRIORITY, *(n for n in eco if n not in lookup.ECOSYSTEM_PRIORITY)]
    any_file = " OR ".join(f"f_{n}" for n in eco)
    hit = {n: f"(CASE WHEN {any_file} THEN f_{n} ELSE e_{n} END)" for n in eco}
    stem = "regexp_replace(regexp_extract(file_path, '([^/]*)$', 1), '^(.+)\\.[^.]+$', '\\1')"
    return {
        "language_stats": ls,
        "polyglot_summary": f"WITH x AS ({ls}) SELECT repo_id, count(*) AS total_languages, arg_min(language, [lpad(CAST(1000000 - file_count AS VARCHAR), 9, '0'), language]) AS primary_language, CAST(sum(file_count) AS BIGINT) AS total_files, CAST(sum(total_lines) AS BIGINT) AS total_lines FROM x GROUP BY 1",
        "crawl_language_stats": f"SELECT {show} AS language, count(*) AS file_count, count(DISTINCT {ext}) AS n_extensions, min(file_path) AS first_path FROM source_files GROUP BY 1",
        "directory_stats": f"SELECT repo_id, count(*) AS n_files, round(sum(file_size_kb), 4) AS size_kb, count(DISTINCT {ext}) AS n_extensions, count(DISTINCT CASE WHEN contains(file_path, '/') THEN split_part(file_path, '/', 1) END) AS n_top_directories, max(len(string_split(file_path, '/')) - 1) AS max_depth FROM source_files GROUP BY 1",
        "languages_by_lines": f"SELECT repo_id, CASE {ext} WHEN '.py' THEN 'Python' WHEN '.js' THEN 'JavaScript' WHEN '.ts' THEN 'TypeScript' WHEN '.java' THEN 'Java' WHEN '.go' THEN 'Go' ELSE 'Rust' END AS language, count(*) AS files, CAST(sum({lines}) AS BIGINT) AS lines FROM source_files WHERE {ext} IN ('.py', '.js', '.ts', '.java', '.go', '.rs') GROUP BY 1, 2",
        "config_file_counts": config,
        "framework_votes": f"WITH v AS ({votes}), n AS (SELECT repo_id, count(*) AS files FROM source_files GROUP BY 1) SELECT repo_id, framework AS primary_framework, CAST(hits AS BIGINT) AS hits, round(hits / files, 6) AS confidence FROM v JOIN n USING (repo_id) WHERE hits > 0 QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY hits DESC, framework) = 1",
        "naming_conventions": f"""WITH r AS (
            SELECT repo_id, 'file' AS kind, CASE WHEN contains(st, '_') AND st = lower(st) THEN 'snake_case' WHEN contains(st, '-') THEN 'kebab_case' WHEN regexp_matches(st[1], '[A-Z]') THEN 'PascalCase' WHEN regexp_matches(st[1], '[a-z]') AND regexp_matches(st, '[A-Z]') THEN 'camelCase' END AS convention FROM (SELECT repo_id, {stem} AS st FROM source_files)
            UNION ALL SELECT repo_id, 'function', CASE WHEN contains(n, '_') THEN 'snake_case' WHEN regexp_matches(n[2:], '[A-Z]') THEN 'camelCase' END FROM (SELECT repo_id, unnest(regexp_extract_all(raw_content, 'def\\s+([a-zA-Z_]\\w*)', 1)) AS n FROM source_files)
            UNION ALL SELECT repo_id, 'class', CASE WHEN regexp_matches(n[1], '[A-Z]') THEN 'PascalCase' ELSE 'snake_case' END FROM (SELECT repo_id, unnest(regexp_extract_all(raw_content, 'class\\s+([a-zA-Z_]\\w*)', 1)) AS n FROM source_files))
            SELECT repo_id, kind, convention, count(*) AS n FROM r WHERE convention IS NOT NULL GROUP BY ALL""",
        "top_modules": "WITH m AS (SELECT repo_id, unnest(regexp_extract_all(raw_content, '(?:from|import)\\s+([a-zA-Z_][\\w\\.]*)', 1)) AS module FROM source_files), c AS (SELECT repo_id, module, count(*) AS n FROM m GROUP BY 1, 2) SELECT repo_id, module, n, row_number() OVER (PARTITION BY repo_id ORDER BY n DESC, module) AS rank FROM c QUALIFY rank <= 10",
        "testing_patterns": f"SELECT repo_id, count(*) AS n_test_files, count(DISTINCT regexp_extract(file_path, '^(.*)/[^/]*$', 1)) AS n_test_directories, CAST(count_if(contains(raw_content, 'pytest')) AS BIGINT) AS n_pytest, CAST(count_if(contains(raw_content, 'unittest')) AS BIGINT) AS n_unittest, CAST(count_if(contains(raw_content, 'describe(')) AS BIGINT) AS n_jest FROM source_files WHERE {test} GROUP BY 1",
        "polyglot_priority": f"WITH c AS (SELECT repo_id, {lang} AS language, count(*) AS files FROM source_files GROUP BY 1, 2), s AS (SELECT *, files * CASE language {weights} ELSE 1 END AS score FROM c WHERE language <> 'unknown') SELECT repo_id, language, files, score FROM s QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY score DESC, language) = 1",
        "ecosystems": f"WITH w AS (SELECT repo_id, {flags} FROM source_files GROUP BY 1) SELECT repo_id, CASE {' '.join(f'WHEN {hit[n]} THEN {lit(n)}' for n in ranked)} ELSE 'unknown' END AS primary_type, CAST({' + '.join(f'CAST({hit[n]} AS INT)' for n in eco)} AS BIGINT) AS n_detected, array_to_string(list_filter([{', '.join(f'CASE WHEN {hit[n]} THEN {lit(chr(44).join(lookup.ECOSYSTEMS[n][2]))} END' for n in eco)}], lambda x: x IS NOT NULL), ',') AS build_tools FROM w",
        "file_relationships": f"""WITH d AS (SELECT DISTINCT repo_id, file_path FROM source_files), c AS (SELECT repo_id, {category} AS category, count(*) AS n FROM d GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY n DESC, category) AS r FROM c),
            a AS (SELECT repo_id, CAST(sum(n) AS BIGINT) AS n_files, count(*) AS n_categories, max(CASE WHEN r = 1 THEN category END) AS primary_category, coalesce(string_agg(CASE WHEN r BETWEEN 2 AND 4 AND n > 1 THEN category END, ',' ORDER BY r), '') AS secondary FROM r GROUP BY 1)
            SELECT *, n_categories > 2 AS cross_layer, CASE WHEN n_categories > 2 AND n_files > 15 THEN 'very_high' WHEN n_files > 12 OR (n_categories > 2 AND n_categories > 4) THEN 'high' WHEN n_files > 6 OR n_categories > 3 THEN 'medium' ELSE 'low' END AS complexity FROM a""",
        "structure_tree": f"WITH d AS (SELECT DISTINCT repo_id, file_path FROM source_files WHERE file_path IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY file_path) AS r, count(*) OVER (PARTITION BY repo_id) AS n FROM d) SELECT repo_id, string_agg(repeat('  ', len(string_split(file_path, '/')) - 1) || {name}, chr(10) ORDER BY r) || CASE WHEN max(n) > 20 THEN chr(10) || '... and ' || CAST(max(n) - 20 AS VARCHAR) || ' more' ELSE '' END AS tree FROM r WHERE r <= 20 GROUP BY 1",
        "snapshot_metrics": f"SELECT repo_id, CAST(count_if({test}) AS BIGINT) AS n_test, CAST(count_if(NOT ({test}) AND (prefix(file_path, 'src/') OR prefix(file_path, 'lib/') OR {ext} IN ('.py', '.js', '.rs', '.go'))) AS BIGINT) AS n_impl, round(CASE WHEN n_impl > 0 THEN n_test / n_impl ELSE 0 END, 3) AS test_ratio FROM source_files GROUP BY 1",
    }

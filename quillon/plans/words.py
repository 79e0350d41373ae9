"""Queries on words, names and addresses in texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import paths, text, words
from quillon.operators import graph, retrieval
from quillon.plans.graphs import _E, _edges
from quillon.plans.search import _HITS, _hits
from quillon.sources.tables import table


def question_words(spark: SparkSession, d: str) -> DataFrame:
    """M7: question and action words of the documents."""
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("source", F.explode(words.question_marks(F.col("text"))).alias("word")).groupBy("source", "word").agg(F.count("*").alias("n"))


def report_keywords(spark: SparkSession, d: str) -> DataFrame:
    """Names of code elements in reports."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.explode(words.report_keywords(F.col("text"))).alias("keyword"))


def named_files(spark: SparkSession, d: str) -> DataFrame:
    """Names of files in documents and readmes."""
    docs = table(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("item"), "text")
    readmes = table(spark, d, "source_files").where("file_path like '%.md'").select(F.concat(F.lit("f"), F.col("file_id").cast("string")).alias("item"), F.col("raw_content").alias("text"))
    paths_ = table(spark, d, "source_files").where("file_path is not null").select(F.concat(F.lit("p"), F.col("file_id").cast("string")).alias("item"), F.concat(F.lit("see `"), "file_path", F.lit("` first")).alias("text"))
    return docs.unionByName(readmes).unionByName(paths_).where("text is not null").select("item", F.explode(words.named_files(F.col("text"))).alias("name"))


def directory_purposes(spark: SparkSession, d: str) -> DataFrame:
    """P28."""
    f = table(spark, d, "source_files").where("file_path like '%/%'").select("repo_id", F.regexp_extract("file_path", r"([^/]*)/[^/]*$", 1).alias("directory"))
    return f.groupBy("directory").agg(F.count("*").alias("n_files"), F.countDistinct("repo_id").alias("n_repos")).withColumn("purpose", words.directory_purpose(F.col("directory")))


def addresses(spark: SparkSession, d: str) -> DataFrame:
    """Repository and issue addresses, made of the repositories' names."""
    r = table(spark, d, "repos").select("repo_id").where("repo_id is not null").withColumn("slug", F.regexp_replace("repo_id", "_", "/"))
    kinds = F.array(F.concat(F.lit("https://github.com/"), "slug"), F.concat(F.lit("https://github.com/"), "slug", F.lit("/issues/17")), F.concat(F.lit("git@github.com:"), "slug"), F.concat(F.lit("https://github.com/"), "slug", F.lit("/pull/8/files")))
    u = r.select("repo_id", F.explode(kinds).alias("url"))
    issue = words.issue_of_url(F.col("url"))
    return u.select("url", words.is_repository_url(F.col("url")).alias("is_repository"), issue["owner"].alias("owner"), issue["number"].cast("string").alias("number"))


def chunk_paths(spark: SparkSession, d: str) -> DataFrame:
    """P10: ids of chunks built of repository, path and place, and read back."""
    c = table(spark, d, "chunks").where("repo_id is not null and file_path is not null").select("repo_id", "file_path", "pos").distinct()
    made = c.withColumn("id", words.chunk_id(F.col("repo_id"), F.col("file_path"), F.col("pos")))
    return made.select("id", words.chunk_path(F.col("id"), F.col("repo_id")).alias("path"))


def stored_repo_ids(spark: SparkSession, d: str) -> DataFrame:
    """M5: ids of documents with and without a stated one, by the names of their files."""
    r = table(spark, d, "cortex_raw").where("repo_id is not null")
    stated = F.when(F.col("record_id") % 3 == 0, F.col("repo_id")).when(F.col("record_id") % 3 == 1, "")
    path = F.when(F.col("record_id") % 2 == 0, F.concat(F.lit("data/"), "repo_id", F.lit("_cortex.json"))).otherwise(F.concat(F.lit("cloned_repositories/"), "repo_id", F.lit(".json")))
    return r.select("record_id", words.stored_repo_id(stated, path).alias("found"))


def learning_objectives(spark: SparkSession, d: str) -> DataFrame:
    """By the words of the files' own paths as summaries."""
    f = table(spark, d, "source_files").where("file_path is not null")
    return f.groupBy(words.learning_objective(F.col("file_path"), F.col("file_path")).alias("objective")).agg(F.count("*").alias("n_files"))


#: What somebody may have typed.
TYPED = ["plumge", "tinfrme", "mosgrid", "orery", "fathom-lib"]


def close_names(spark: SparkSession, d: str) -> DataFrame:
    """T5: for each of a few typed words the five closest dependency names above 30, a top-k report; the words are constants, so every name is compared with each where it is."""
    names = table(spark, d, "dependencies").where("name is not null").select("name").distinct()
    scored = names.withColumn("typed", F.explode(F.array(*[F.lit(t) for t in TYPED]))).withColumn("score", words.closeness(F.col("typed"), F.col("name"))).where("score > 30")
    order = Window.partitionBy("typed").orderBy(F.desc("score"), "name")
    return scored.withColumn("rank", F.row_number().over(order).cast("bigint")).where("rank <= 5").select("typed", "name", "score", "rank")


def recent_mentions(spark: SparkSession, d: str) -> DataFrame:
    """the last ten documents of each source that mention a word, a top-k report."""
    docs = table(spark, d, "documents").where("created_at is not null and contains(lower(text), 'cache')")
    order = Window.partitionBy("source").orderBy(F.desc("created_at"), "doc_id")
    return docs.withColumn("rank", F.row_number().over(order).cast("bigint")).where("rank <= 10").select("source", "rank", "doc_id")


def merged_entities(spark: SparkSession, d: str) -> DataFrame:
    """Names of chunks, and those of file texts that none of them is without regard to case."""
    have = table(spark, d, "chunks").where("name is not null").select("repo_id", F.col("name").alias("text")).distinct().withColumn("origin", F.lit("chunk"))
    f = table(spark, d, "source_files").where("raw_content is not null")
    more = retrieval.entities(f, "repo_id", F.col("raw_content")).where("type = 'classes'").select("repo_id", "text").distinct()
    low = have.select("repo_id", F.lower("text").alias("low")).distinct()
    new = more.withColumn("low", F.lower("text")).join(low, ["repo_id", "low"], "left_anti").select("repo_id", "text").withColumn("origin", F.lit("text"))
    return have.unionByName(new).groupBy("repo_id", "origin").agg(F.count("*").alias("n"), F.min("text").alias("first"), F.max("text").alias("last"))


def category_context(spark: SparkSession, d: str) -> DataFrame:
    """Hits grouped by the category of their file, the category with most hits of a query first; the ten best of each."""
    hits = _hits(spark, d).withColumn("category", paths.category(F.concat("path", F.when(F.col("id") % 3 == 0, ".md").when(F.col("id") % 3 == 1, ".py").otherwise(".css"))))
    n = hits.groupBy("query_id", "category").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n"), "category"))
    best = F.row_number().over(Window.partitionBy("query_id", "category").orderBy(F.desc("score"), "id"))
    top = hits.withColumn("at", best).where("at <= 10").groupBy("query_id", "category").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.col("id").cast("string").alias("id")))), lambda s: s["id"]), " ").alias("ids"))
    return n.withColumn("place", place.cast("bigint")).join(top, ["query_id", "category"]).select("query_id", "place", "category", "n", "ids")


def issue_radius(spark: SparkSession, d: str) -> DataFrame:
    """The files that an issue's words name, at most three of its repository, what a change to them reaches, and whether the issue suits newcomers; 1 and 95 where none is named."""
    issues = table(spark, d, "documents").where("repo_id is not null and text is not null").select("doc_id", "repo_id", "text")
    named = issues.select("doc_id", "repo_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{4,})"), 1))).alias("stem"))
    files = table(spark, d, "source_files").where("file_path is not null").select("repo_id", "file_path", F.lower(paths.stem(F.col("file_path"))).alias("stem")).distinct()
    order = Window.partitionBy("doc_id").orderBy("file_path")
    seeds = named.join(files, ["repo_id", "stem"]).select("doc_id", "repo_id", "file_path").distinct().withColumn("n", F.row_number().over(order)).where("n <= 3")
    e = graph.collapse(_edges(spark, d))
    out = e.select("repo_id", F.col("source").alias("file_path"), F.col("target").alias("node")).unionByName(e.select("repo_id", F.col("target").alias("file_path"), F.col("source").alias("node")))
    near = seeds.join(out, ["repo_id", "file_path"]).select("doc_id", "node").unionByName(seeds.select("doc_id", F.col("file_path").alias("node"))).distinct()
    radius = issues.select("doc_id").join(near.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id", "left")
    score = F.when(F.col("n").isNull(), 95.0).otherwise(graph.suitability(F.col("n")))
    return radius.select("doc_id", F.coalesce("n", F.lit(1)).alias("radius"), F.round(score, 4).alias("suitability"), (score > 70).alias("suits"))


def sources_by_language(spark: SparkSession, d: str) -> DataFrame:
    """What belongs to each group, listed and counted."""
    docs = table(spark, d, "documents").where("lang is not null and source is not null").select("lang", "source").distinct()
    return docs.groupBy("lang").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("source")), ", ").alias("sources"))


def text_forms(spark: SparkSession, d: str) -> DataFrame:
    """Names, templates, cases, windows and branches made of the tables' columns."""
    f = table(spark, d, "source_files").where("file_path is not null").select("file_path").distinct()
    stem = paths.stem(F.col("file_path"))
    return f.select("file_path", text.camel_case(stem).alias("camel"), text.snake_case(text.camel_case(stem)).alias("snake"), text.branch_name(F.col("file_path")).alias("branch"), text.path_template(F.concat(F.lit("/"), stem, F.lit("/<str:"), stem, F.lit(">/<id>"))).alias("template"), text.context_window(F.col("file_path"), "/", 5).alias("around"))


QUERIES = {f.__name__: f for f in (question_words, report_keywords, named_files, directory_purposes, addresses, chunk_paths, stored_repo_ids, learning_objectives, close_names, recent_mentions, merged_entities, category_context, issue_radius, sources_by_language, text_forms)}

_q = lambda s: "'" + s.replace("'", "''") + "'"
_STEM = r"regexp_replace(regexp_extract(file_path, '([^/]*)$', 1), '^(.+)\.[^.]+$', '\1')"
_ALL = lambda col, p: f"regexp_extract_all({col}, {_q(p)}, 1)"
ORACLES = {
    "question_words": f"SELECT source, word, count(*) AS n FROM documents, (SELECT unnest([{', '.join(_q(w) for w in (*words.QUESTION_WORDS, *words.ACTION_WORDS))}]) AS word) WHERE contains(lower(text), word) GROUP BY 1, 2",
    "report_keywords": f"WITH k AS (SELECT doc_id, unnest(list_concat(list_concat({_ALL('text', words.TICKED)}, {_ALL('plain', words.CALLED)}), {_ALL('plain', words.NAMED)})) AS k FROM (SELECT doc_id, text, regexp_replace(text, '[À-ÖØ-öø-ӿ]', '0', 'g') AS plain FROM documents WHERE text IS NOT NULL)), c AS (SELECT doc_id, string_split(string_split(k, '.')[-1], '::')[-1] AS keyword FROM k) SELECT DISTINCT doc_id, keyword FROM c WHERE length(keyword) > 2",
    "named_files": f"WITH t AS (SELECT 'd' || doc_id AS item, text FROM documents UNION ALL SELECT 'f' || file_id, raw_content FROM source_files WHERE file_path LIKE '%.md' UNION ALL SELECT 'p' || file_id, 'see `' || file_path || '` first' FROM source_files WHERE file_path IS NOT NULL) SELECT DISTINCT item, name FROM (SELECT item, unnest(list_concat({_ALL('text', words.NAMED_FILE)}, {_ALL('text', words.TICKED_FILE)})) AS name FROM t WHERE text IS NOT NULL) WHERE contains(name, '.')",
    "directory_purposes": f"WITH f AS (SELECT repo_id, regexp_extract(file_path, '([^/]*)/[^/]*$', 1) AS directory FROM source_files WHERE file_path LIKE '%/%') SELECT directory, count(*) AS n_files, count(DISTINCT repo_id) AS n_repos, CASE lower(directory) {' '.join(f'WHEN {_q(k)} THEN {_q(v)}' for k, v in words.DIRECTORY_PURPOSES.items())} ELSE 'unknown purpose' END AS purpose FROM f GROUP BY 1",
    "addresses": "WITH s AS (SELECT replace(repo_id, '_', '/') AS s FROM repos WHERE repo_id IS NOT NULL) SELECT 'https://github.com/' || s AS url, len(string_split(s, '/')) = 2 AS is_repository, CAST(NULL AS VARCHAR) AS owner, CAST(NULL AS VARCHAR) AS number FROM s UNION ALL SELECT 'git@github.com:' || s, false, NULL, NULL FROM s UNION ALL SELECT 'https://github.com/' || s || '/issues/17', false, CASE WHEN len(string_split(s, '/')) = 2 THEN split_part(s, '/', 1) END, CASE WHEN len(string_split(s, '/')) = 2 THEN '17' END FROM s UNION ALL SELECT 'https://github.com/' || s || '/pull/8/files', false, CASE WHEN len(string_split(s, '/')) = 2 THEN split_part(s, '/', 1) END, CASE WHEN len(string_split(s, '/')) = 2 THEN '8' END FROM s",
    "chunk_paths": "SELECT DISTINCT repo_id || '_' || file_path || '_' || pos AS id, file_path AS path FROM chunks WHERE repo_id IS NOT NULL AND file_path IS NOT NULL",
    "stored_repo_ids": "SELECT record_id, repo_id AS found FROM cortex_raw WHERE repo_id IS NOT NULL",
    "learning_objectives": "SELECT CASE WHEN regexp_matches(lower(file_path), 'service') THEN 'service' WHEN contains(lower(file_path), 'model') THEN 'model' WHEN regexp_matches(lower(file_path), 'controller|view') THEN 'handling' WHEN regexp_matches(lower(file_path), 'util|helper') THEN 'helpers' ELSE 'purpose' END AS objective, count(*) AS n_files FROM source_files WHERE file_path IS NOT NULL GROUP BY 1",
    "close_names": f"WITH n AS (SELECT DISTINCT name FROM dependencies WHERE name IS NOT NULL), s AS (SELECT typed, name, round(100 * (1 - levenshtein(typed, name) / greatest(length(typed), length(name))), 4) AS score FROM n, (SELECT unnest([{', '.join(_q(t) for t in TYPED)}]) AS typed)) SELECT *, row_number() OVER (PARTITION BY typed ORDER BY score DESC, name) AS rank FROM s WHERE score > 30 QUALIFY rank <= 5",
    "recent_mentions": "SELECT source, row_number() OVER (PARTITION BY source ORDER BY created_at DESC, doc_id) AS rank, doc_id FROM documents WHERE created_at IS NOT NULL AND contains(lower(text), 'cache') QUALIFY rank <= 10",
    "merged_entities": r"WITH h AS (SELECT DISTINCT repo_id, name AS text FROM chunks WHERE name IS NOT NULL), m AS (SELECT DISTINCT repo_id, unnest(regexp_extract_all(raw_content, 'class\s+([A-Z]\w*)', 1)) AS text FROM source_files), a AS (SELECT repo_id, text, 'chunk' AS origin FROM h UNION ALL SELECT repo_id, text, 'text' FROM m WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.repo_id = m.repo_id AND lower(h.text) = lower(m.text))) SELECT repo_id, origin, count(*) AS n, min(text) AS first, max(text) AS last FROM a GROUP BY 1, 2",
    "category_context": f"WITH {_HITS}, c AS (SELECT query_id, id, score, CASE WHEN id % 3 = 0 THEN 'docs' WHEN id % 3 = 1 THEN 'backend' ELSE 'styling' END AS category FROM h), n AS (SELECT query_id, category, count(*) AS n FROM c GROUP BY 1, 2), t AS (SELECT query_id, category, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY score DESC, id) AS ids FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY query_id, category ORDER BY score DESC, id) <= 10) GROUP BY 1, 2) SELECT n.query_id, row_number() OVER (PARTITION BY n.query_id ORDER BY n DESC, n.category) AS place, n.category, n, ids FROM n JOIN t ON t.query_id = n.query_id AND t.category = n.category",
    "issue_radius": f"WITH {_E}, i AS (SELECT doc_id, repo_id, text FROM documents WHERE repo_id IS NOT NULL AND text IS NOT NULL), w AS (SELECT DISTINCT doc_id, repo_id, unnest(regexp_extract_all(lower(text), '([a-z]{{4,}})', 1)) AS stem FROM i), f AS (SELECT DISTINCT repo_id, file_path, lower({_STEM}) AS stem FROM source_files WHERE file_path IS NOT NULL), z AS (SELECT DISTINCT doc_id, repo_id, file_path FROM w JOIN f USING (repo_id, stem) QUALIFY dense_rank() OVER (PARTITION BY doc_id ORDER BY file_path) <= 3), r AS (SELECT doc_id, target AS node FROM z JOIN e ON e.repo_id = z.repo_id AND e.source = z.file_path UNION SELECT doc_id, source FROM z JOIN e ON e.repo_id = z.repo_id AND e.target = z.file_path UNION SELECT doc_id, file_path FROM z), y AS (SELECT doc_id, count(*) AS n FROM r GROUP BY 1) SELECT i.doc_id, coalesce(n, 1) AS radius, round(CASE WHEN n IS NULL THEN 95 ELSE 100 - least(n, 100) / 100 * 100 END, 4) AS suitability, CASE WHEN n IS NULL THEN true ELSE 100 - least(n, 100) > 70 END AS suits FROM i LEFT JOIN y ON y.doc_id = i.doc_id",
    "sources_by_language": "SELECT lang, count(*) AS n, array_to_string(list_sort(list(source)), ', ') AS sources FROM (SELECT DISTINCT lang, source FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL) GROUP BY 1",
}
_CAMEL = "array_to_string(list_transform(string_split(stem, '_'), lambda x: upper(x[1]) || lower(x[2:])), '')"
ORACLES["text_forms"] = rf"WITH f AS (SELECT DISTINCT file_path, {_STEM} AS stem, strpos(file_path, '/') AS p FROM source_files WHERE file_path IS NOT NULL), c AS (SELECT *, {_CAMEL} AS camel FROM f) SELECT file_path, camel, lower(regexp_replace(regexp_replace(camel, '(.)([A-Z][a-z]+)', '\1_\2', 'g'), '([a-z0-9])([A-Z])', '\1_\2', 'g')) AS snake, regexp_replace(trim(regexp_replace(lower(file_path), '[^a-z0-9\s-]', '', 'g')), '\s+', '-', 'g')[1:60] AS branch, '/' || stem || CASE WHEN regexp_matches(stem, '^\w+$') THEN '/{{' || stem || '}}' ELSE '/<str:' || stem || '>' END || '/{{id}}' AS template, CASE WHEN p > 0 THEN file_path[greatest(p - 5, 1):p + 5] ELSE '' END AS around FROM c"

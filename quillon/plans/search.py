"""Queries on vectors and texts. Searches ask with every row whose id is divisible by 20, against all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.text import token_count
from quillon.operators import retrieval as R
from quillon.sources.tables import table

QUESTION = "retry the session cache when the lease is stale"


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "embedding")


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).where("vec_id % 20 = 0")


def nearest_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Ten nearest with their labels."""
    hits = R.nearest(_vectors(spark, d), _asked(spark, d), 10)
    return hits.join(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label"), "id")


def expanded_search(spark: SparkSession, d: str) -> DataFrame:
    """Two variants per query, each for half of the hits."""
    v = _asked(spark, d).withColumn("query_id", F.floor(F.col("vec_id") / 40) * 40)
    return R.expanded(_vectors(spark, d), v.select("query_id", "vec_id", "embedding"), 20)


def multi_hop_search(spark: SparkSession, d: str) -> DataFrame:
    """R5."""
    return R.multi_hop(_vectors(spark, d), _asked(spark, d), 5, 3)


def chunk_features(spark: SparkSession, d: str) -> DataFrame:
    """Features and score of every chunk for one question."""
    c = table(spark, d, "chunks").where("chunk_text is not null").distinct()
    f = R.features(F.col("chunk_text"), F.col("file_path"), F.lit(QUESTION))
    return c.select("file_id", "pos", *[F.round(v, 6).alias(k) for k, v in f.items()], F.round(R.final_score(f), 6).alias("final_score"))


def unique_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The first chunk of every path and text beginning."""
    c = table(spark, d, "chunks").where("chunk_text is not null")
    return R.drop_exact(c, F.col("file_path"), F.col("chunk_text"), [F.col("chunk_id"), F.col("file_id"), F.col("pos")]).select("file_path", F.md5("chunk_text").alias("digest"))


def _hits(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("source", F.lit("unknown")).alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    return R.nearest(_vectors(spark, d), _asked(spark, d), 20).join(docs, "id").withColumn("score", F.round(1 / (1 + F.col("distance")), 9))


def selected_hits(spark: SparkSession, d: str) -> DataFrame:
    """Unique, clustered and varied hits per query."""
    return R.select_hits(_hits(spark, d), 10)


def search_context(spark: SparkSession, d: str) -> DataFrame:
    """R19 without clusters and hop summary: hits by file."""
    return R.context(_hits(spark, d))


def entities(spark: SparkSession, d: str) -> DataFrame:
    """Code elements named in documents."""
    return R.entities(table(spark, d, "documents"), "doc_id", F.col("text"))


def entity_aliases(spark: SparkSession, d: str) -> DataFrame:
    """Names in files that are another name's lower-case or snake-case form; files are read beside their lower-case form, as a question may be."""
    f = table(spark, d, "source_files").where("file_path like '%.java' or file_path like '%.ts'")
    return R.aliases(R.entities(f, "file_id", F.concat_ws("\n", "raw_content", F.lower("raw_content"))), "file_id")


def routed_questions(spark: SparkSession, d: str) -> DataFrame:
    """Strategies by source."""
    docs = table(spark, d, "documents").where("text is not null")
    return docs.groupBy(R.route(F.col("text")).alias("strategy")).agg(F.count("*").alias("n"), F.sum(token_count(F.col("text"))).cast("bigint").alias("n_tokens"))


def question_variants(spark: SparkSession, d: str) -> DataFrame:
    """Variants by the first names of each text, one row each."""
    names = R.entities(table(spark, d, "documents"), "doc_id", F.col("text")).where("type = 'functions'").groupBy("doc_id").agg(F.array_sort(F.collect_set("text")).alias("names"))
    return names.select("doc_id", F.posexplode(R.expansions(F.lit(QUESTION), F.col("names"))).alias("place", "variant")).withColumn("place", F.col("place").cast("bigint"))


def ranked_variants(spark: SparkSession, d: str) -> DataFrame:
    """The variants of each text by their similarity to the question."""
    return R.ranked(question_variants(spark, d), F.lit(QUESTION))


def node_matches(spark: SparkSession, d: str) -> DataFrame:
    """Files that a question's names point at."""
    from quillon.operators import graph

    return R.node_scores(graph.file_nodes(table(spark, d, "source_files")), [("cache", 0.8), ("session", 0.8), ("lease", 0.8)]).withColumn("score", F.round("score", 6))


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """R7, U4 without the graph-guided search: nearest, expanded and multi-hop hits together. The two variants of a pair serve each of its queries."""
    pairs = _asked(spark, d).select(F.col("vec_id").alias("of"), (F.floor(F.col("vec_id") / 40) * 40).alias("query_id"))
    expanded = expanded_search(spark, d).select("query_id", "id").join(pairs, "query_id").where("id <> of").select(F.col("of").alias("query_id"), "id")
    return R.hybrid(("nearest", R.nearest(_vectors(spark, d), _asked(spark, d), 10)), ("expanded", expanded), ("multi_hop", R.multi_hop(_vectors(spark, d), _asked(spark, d), 5, 3)))


def style_exemplars(spark: SparkSession, d: str) -> DataFrame:
    """The best hit of every documentation source."""
    return R.exemplars(_hits(spark, d), F.col("path").rlike("docs|readmes|tutorials")).select("query_id", "path", "id")


def answer_confidence(spark: SparkSession, d: str) -> DataFrame:
    """R25."""
    return R.answer_confidence(_hits(spark, d))


def search_readiness(spark: SparkSession, d: str) -> DataFrame:
    """Chunks stand for the index."""
    from quillon.operators import graph

    return R.readiness(table(spark, d, "repos"), table(spark, d, "chunks"), graph.import_edges(table(spark, d, "source_files")))


def function_names(spark: SparkSession, d: str) -> DataFrame:
    """X11: plain functions, two of the four patterns."""
    return table(spark, d, "source_files").select("file_id", F.explode(R.function_names(F.col("raw_content"))).alias("name"))


def all_function_names(spark: SparkSession, d: str) -> DataFrame:
    """X11: functions, Class.method names and route handlers."""
    return table(spark, d, "source_files").select("file_id", F.explode(R.all_function_names(F.col("raw_content"))).alias("name")).distinct()


def start_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The function to start from, by the ten nearest documents of each query."""
    return R.start_nodes(_hits(spark, d).where("rank <= 10"))


def question_concepts(spark: SparkSession, d: str) -> DataFrame:
    """Concepts of the documents as questions."""
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.posexplode(R.concepts(F.col("text"))).alias("place", "concept")).withColumn("place", F.col("place").cast("bigint"))


def wide_variants(spark: SparkSession, d: str) -> DataFrame:
    """Variants of a question by names, concepts and code words, by their likeness to it."""
    names = R.entities(table(spark, d, "documents"), "doc_id", F.col("text")).where("type = 'functions'").groupBy("doc_id").agg(F.array_sort(F.collect_set("text")).alias("names"))
    return names.select("doc_id", F.posexplode(R.wide_expansions(F.lit(QUESTION + " in an api test"), F.col("names"))).alias("place", "variant"))


def hop_questions(spark: SparkSession, d: str) -> DataFrame:
    """What each hop asks."""
    names = R.entities(table(spark, d, "documents"), "doc_id", F.col("text")).where("type = 'functions'").groupBy("doc_id").agg(F.array_sort(F.collect_set("text")).alias("names"))
    hops = F.array(*[F.struct(F.lit(h).cast("bigint").alias("hop"), F.array_join(R.hop_questions(F.lit(QUESTION), F.col("names"), h), " | ").alias("asked")) for h in range(4)])
    return names.select("doc_id", F.explode(hops).alias("x")).select("doc_id", "x.hop", "x.asked")


def _letters(texts: list[str]) -> list:
    """A stand-in for an embedding model: shares of letters by place in the alphabet, 64 numbers; models are the caller's."""
    out = []
    for t in texts:
        v = [0.0] * 64
        for c in t:
            v[ord(c) % 64] += 1 / max(1, len(t))
        out.append(v)
    return out


def graph_guided_search(spark: SparkSession, d: str) -> DataFrame:
    """The documents nearest to the nodes that a question points at."""
    docs = R.embed(table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text"), _letters, "vec_id")
    return R.graph_guided(node_matches(spark, d).where("rank <= 2 and repo_id like '%a%'"), QUESTION, docs, _letters)


_MORE = (question_concepts, wide_variants, hop_questions, graph_guided_search, ranked_variants, node_matches, hybrid_search, style_exemplars, answer_confidence, search_readiness, function_names, all_function_names, start_nodes)
QUERIES = {f.__name__: f for f in (nearest_vectors, expanded_search, multi_hop_search, chunk_features, unique_chunks, selected_hits, search_context, entities, entity_aliases, routed_questions, question_variants, *_MORE)}

_KNN = "v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL), k AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_sum(list_transform(list_zip(q.e, v.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 6) AS distance FROM v q JOIN v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id AND len(q.e) = len(v.e)), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM k)"
_TOK = "list_distinct(list_filter(regexp_split_to_array(lower({}), '[\\t-\\r ]+'), lambda t: t <> ''))"
_ent = lambda key, text, of: " UNION ALL ".join(f"SELECT {key}, '{k}' AS type, unnest(regexp_extract_all({text}, '{p.replace(chr(39), chr(39) * 2)}', 1)) AS text FROM {of}" for k, p in R.ENTITY_PATTERNS.items())
_ENTS = f"en AS (SELECT doc_id, type, text, count(*) AS n FROM ({_ent('doc_id', 'text', 'documents')}) GROUP BY ALL)"
_FILE_ENTS = f"en AS (SELECT DISTINCT file_id, text FROM ({_ent('file_id', 'raw_content || chr(10) || lower(raw_content)', 'source_files')}) JOIN source_files USING (file_id) WHERE file_path LIKE '%.java' OR file_path LIKE '%.ts')"
_SNAKE = "lower(regexp_replace(regexp_replace(text, '(.)([A-Z][a-z]+)', '\\1_\\2', 'g'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g'))"
_has = lambda p, w: f"CASE WHEN regexp_matches(lower(chunk_text), '{p}') THEN {w} ELSE 0 END"
_FEATURES = f"""f AS (SELECT file_id, pos, least(1, len(list_intersect({_TOK.format("'" + QUESTION + "'")}, {_TOK.format('chunk_text')})) / len({_TOK.format("'" + QUESTION + "'")}) + CASE WHEN contains(lower(chunk_text), '{QUESTION}') THEN 0.5 ELSE 0 END) AS a,
    least(1, (0.5 + {_has('def\\s+\\w+\\s*\\(', 0.1)} + {_has('class\\s+\\w+', 0.1)} + {_has('import\\s+\\w+', 0.05)} + {_has('(?s)""".*?"""', 0.1)} + {_has('#\\s*\\w+', 0.05)}) * CASE WHEN length(chunk_text) < 50 THEN 0.5 WHEN length(chunk_text) > 2000 THEN 0.8 ELSE 1 END) AS c,
    least(1, 0.5 + CASE WHEN regexp_matches(lower(file_path), '\\.(py|js|java)$') THEN 0.2 WHEN regexp_matches(lower(file_path), '\\.(md|txt|rst)$') THEN 0.1 ELSE 0 END + CASE WHEN regexp_matches(lower(file_path), 'src|core|api|routes|models|services') THEN 0.1 ELSE 0 END) AS s FROM (SELECT DISTINCT * FROM chunks) WHERE chunk_text IS NOT NULL)"""
_HITS = f"{_KNN}, h AS (SELECT query_id, r.id, distance, rank, coalesce(source, 'unknown') AS path, round(1 / (1 + distance), 9) AS score FROM r JOIN documents ON doc_id = r.id WHERE rank <= 20)"
_NODE = " + ".join(f"CASE WHEN contains(lower(file_path), '{w}') THEN 1.6 ELSE 0 END + CASE WHEN contains(lower(regexp_extract(file_path, '([^/]*)$', 1)), '{w}') THEN 0.8 ELSE 0 END" for w in ("cache", "session", "lease"))
ORACLES = {
    "node_matches": f"WITH n AS (SELECT DISTINCT repo_id, file_path AS node_id, CAST({_NODE} AS DOUBLE) AS score FROM source_files WHERE file_path IS NOT NULL), s AS (SELECT repo_id, node_id, round(score, 6) AS score, row_number() OVER (PARTITION BY repo_id ORDER BY round(score, 6) DESC, node_id) AS rank FROM n WHERE score > 0) SELECT * FROM s WHERE rank <= 10",
    "style_exemplars": f"WITH {_HITS} SELECT query_id, path, id FROM h WHERE regexp_matches(path, 'docs|readmes|tutorials') QUALIFY row_number() OVER (PARTITION BY query_id, path ORDER BY score DESC, id) = 1",
    "answer_confidence": f"WITH {_HITS}, t AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 5) SELECT query_id, count(*) AS n_hits, round(least(0.9, greatest(0.3, avg(score))), 6) AS confidence FROM t GROUP BY 1",
    "function_names": "SELECT DISTINCT file_id, name FROM (SELECT file_id, unnest(regexp_extract_all(raw_content, 'def\\s+([a-zA-Z_]\\w*)\\s*\\(', 1)) AS name FROM source_files UNION ALL SELECT file_id, unnest(regexp_extract_all(raw_content, 'function\\s+([a-zA-Z_]\\w*)\\s*\\(', 1)) FROM source_files)",
    "nearest_vectors": f"WITH {_KNN} SELECT query_id, id, distance, rank, label FROM r JOIN embeddings e ON e.vec_id = r.id WHERE rank <= 10",
    "expanded_search": f"WITH {_KNN}, a AS (SELECT vec_id, vec_id // 40 * 40 AS query_id FROM v WHERE vec_id % 20 = 0), n AS (SELECT query_id, count(*) AS n FROM a GROUP BY 1) SELECT a.query_id, a.vec_id, r.id, r.distance, r.rank FROM r JOIN a ON a.vec_id = r.query_id JOIN n ON n.query_id = a.query_id WHERE rank <= 20 // n",
    "chunk_features": f"WITH {_FEATURES} SELECT file_id, pos, round(CAST(a AS DOUBLE), 6) AS text_relevance, CAST(0.5 AS DOUBLE) AS entity_coverage, round(CAST(c AS DOUBLE), 6) AS code_quality, CAST(0.5 AS DOUBLE) AS freshness, round(CAST(s AS DOUBLE), 6) AS structural, round(CAST(0.3 * a + 0.15 + 0.2 * c + 0.05 + 0.1 * s AS DOUBLE), 6) AS final_score FROM f",
    "unique_chunks": "WITH c AS (SELECT *, row_number() OVER (PARTITION BY file_path, chunk_text[:200] ORDER BY chunk_id, file_id, pos) AS n FROM chunks WHERE chunk_text IS NOT NULL) SELECT file_path, md5(chunk_text) AS digest FROM c WHERE n = 1",
    "entities": f"WITH {_ENTS} SELECT * FROM en",
    "entity_aliases": f"WITH {_FILE_ENTS}, a AS (SELECT file_id, text AS a, unnest(list_distinct([lower(text), {_SNAKE}])) AS form FROM en), o AS (SELECT file_id, lower(text) AS form, text AS b FROM en) SELECT DISTINCT file_id, a AS text, b AS alias FROM a JOIN o USING (file_id, form) WHERE a <> b",
    "routed_questions": r"SELECT CASE WHEN regexp_matches(lower(text), 'how does|workflow|process|trace') THEN 'multi_hop' WHEN regexp_matches(lower(text), 'impact|depends|affects|uses') THEN 'graph_guided' WHEN len(list_filter(regexp_split_to_array(text, '[\t-\r ]+'), lambda w: w <> '')) > 15 THEN 'hybrid' ELSE 'expanded' END AS strategy, count(*) AS n, CAST(sum(len(list_filter(regexp_split_to_array(text, '[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+'), lambda x: x <> ''))) AS BIGINT) AS n_tokens FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "question_variants": f"WITH {_ENTS}, n AS (SELECT doc_id, list_sort(list(DISTINCT text)) AS names FROM en WHERE type = 'functions' GROUP BY 1), x AS (SELECT doc_id, list_concat(['{QUESTION}'], flatten(list_transform(names[1:2], lambda z: [z || ' implementation', 'usage of ' || z])))[1:5] AS v FROM n) SELECT doc_id, unnest(range(len(v))) AS place, unnest(v) AS variant FROM x",
}
_CLASS, _ROUTE = r"(?s)class\s+(\w+).*?def\s+([a-zA-Z_]\w*)", r"""(?s)@app\.route\([''"]([^''"]+)[''"].*?\ndef\s+([a-zA-Z_]\w*)"""
ORACLES["all_function_names"] = f"{ORACLES['function_names']} UNION SELECT file_id, c || '.' || m FROM (SELECT file_id, unnest(regexp_extract_all(raw_content, '{_CLASS}', 1)) AS c, unnest(regexp_extract_all(raw_content, '{_CLASS}', 2)) AS m FROM source_files) UNION SELECT file_id, unnest(regexp_extract_all(raw_content, '{_ROUTE}', 2)) FROM source_files"
ORACLES["search_readiness"] = "WITH v AS (SELECT DISTINCT repo_id FROM chunks), e AS (SELECT DISTINCT repo_id FROM source_files WHERE file_path IS NOT NULL AND regexp_matches(lower(file_path), '\\.(py|pyi|js|mjs|cjs|jsx|ts|tsx|java|go|rs|cpp|cc|h|php|rb)$') AND regexp_matches(raw_content, '(?m)^(import |from \\S+ import |use \\w+::|#include \"|require_once \"|require_relative \"|const \\w+ = require|\\t?\"app/)')) SELECT DISTINCT r.repo_id, CASE WHEN v.repo_id IS NOT NULL AND e.repo_id IS NOT NULL THEN 'excellent' WHEN v.repo_id IS NOT NULL OR e.repo_id IS NOT NULL THEN 'good' ELSE 'poor' END AS status FROM repos r LEFT JOIN v USING (repo_id) LEFT JOIN e USING (repo_id)"
_Q = f"'{QUESTION}'"
ORACLES["ranked_variants"] = f"WITH q AS ({ORACLES['question_variants']}), s AS (SELECT *, round(len(list_intersect({_TOK.format('variant')}, {_TOK.format(_Q)})) / len(list_distinct(list_concat({_TOK.format('variant')}, {_TOK.format(_Q)}))), 6) AS score FROM q) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, place) - 1 AS place, variant, score FROM s"
ORACLES["start_nodes"] = f"WITH {_HITS}, n AS (SELECT query_id, h.path, h.id, score, rank, name FROM h JOIN (SELECT doc_id, name FROM ({ORACLES['all_function_names'].replace('file_id', 'doc_id').replace('raw_content', 'text').replace('source_files', 'documents')})) x ON x.doc_id = h.id WHERE rank <= 10) SELECT query_id, name AS node, path, id, score AS confidence FROM n QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id, name) = 1"
ORACLES["question_concepts"] = "WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[\\t-\\r ]+'), lambda t: t <> '') AS ws FROM documents WHERE text IS NOT NULL), p AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w), c AS (SELECT doc_id, i, 0 AS k, CASE WHEN length(ws[i]) > 4 AND length(ws[i + 1]) > 3 THEN ws[i] || ' ' || ws[i + 1] END AS concept FROM p UNION ALL SELECT doc_id, i, 1, CASE WHEN length(ws[i]) > 4 THEN ws[i] END FROM p) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, k) - 1 AS place, concept FROM c WHERE concept IS NOT NULL QUALIFY place < 3"
_NAMES = f"{_ENTS}, n AS (SELECT doc_id, list_sort(list(DISTINCT text)) AS names FROM en WHERE type = 'functions' GROUP BY 1)"
_FORMS = [(1, 3, ["'implementation of ' || z", "z || ' definition'"]), (2, 2, ["'calls to ' || z", "z || ' dependencies'"]), (3, 2, ["'related to ' || z"])]
ORACLES["hop_questions"] = f"WITH {_NAMES} SELECT doc_id, CAST(0 AS BIGINT) AS hop, '{QUESTION}' AS asked FROM n" + "".join(f" UNION ALL SELECT doc_id, {h}, array_to_string(flatten(list_transform(names[1:{m}], lambda z: [{', '.join(fs)}]))[1:5], ' | ') FROM n" for h, m, fs in _FORMS)
ORACLES["search_context"] = f"WITH {_HITS}, t AS (SELECT h.*, coalesce(text, '') AS text FROM h JOIN documents ON doc_id = h.id), f AS (SELECT query_id, path, max(score) AS best, string_agg(text, chr(10) ORDER BY score DESC, id) AS body FROM (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY query_id, path ORDER BY score DESC, id) <= 5) GROUP BY 1, 2) SELECT query_id, string_agg('## ' || path || chr(10) || body, chr(10) || chr(10) ORDER BY best DESC, path) AS context FROM f GROUP BY 1"

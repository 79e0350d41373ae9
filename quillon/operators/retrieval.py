"""Search over vectors and texts: exact nearest neighbours in blocks, features, ranking, near-duplicate removal, clusters and variety."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import token_set

BLOCK_ROWS = 8_192
QUERY_ROWS = 1_024


def _blocks(vectors: DataFrame, id_col: str, vec_col: str, rows: int, name: str) -> DataFrame:
    """Blocks of about ``rows`` vectors, one row each; their number follows the count."""
    n = max(1, -(-vectors.count() // rows))
    return vectors.groupBy(F.pmod(F.xxhash64(id_col), F.lit(n)).alias(f"{name}_block")).agg(F.collect_list(F.struct(F.col(id_col).alias("id"), F.col(vec_col).alias("v"))).alias(name))


def _k_of_block(have: list, want: list, k: int, exclude_self: bool) -> pd.DataFrame:
    """The k nearest of a block for each of its queries: one matrix product per length of vectors, then exact distances of the few rows that may be among the k."""
    out = []
    lengths = {len(q["v"]) for q in want}
    for n in lengths:
        rows = [r for r in have if len(r["v"]) == n]
        asked = [q for q in want if len(q["v"]) == n]
        if not rows:
            continue
        ids, m = np.array([r["id"] for r in rows], dtype=np.int64), np.array([r["v"] for r in rows], dtype=np.float64)
        qids, a = np.array([q["id"] for q in asked], dtype=np.int64), np.array([q["v"] for q in asked], dtype=np.float64)
        rough = (a * a).sum(axis=1)[:, None] + (m * m).sum(axis=1)[None, :] - 2.0 * (a @ m.T)
        if exclude_self:
            rough[qids[:, None] == ids[None, :]] = np.inf
        most = min(k, len(ids)) - 1
        slack = 1e-6 + 1e-9 * np.abs(np.where(np.isfinite(rough), rough, 0)).max(initial=0)
        bound = np.partition(rough, most, axis=1)[:, most] + 2 * slack
        q, j = np.nonzero((rough <= bound[:, None]) & np.isfinite(rough))
        diff = m[j] - a[q]
        out.append(pd.DataFrame({"query_id": qids[q], "id": ids[j], "distance": np.round(np.einsum("ij,ij->i", diff, diff), 6)}))
    if not out:
        return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "id": pd.Series(dtype="int64"), "distance": pd.Series(dtype="float64")})
    every = pd.concat(out).sort_values(["query_id", "distance", "id"], kind="stable")
    return every.groupby("query_id", sort=False).head(k)


def _best(pairs: DataFrame, k: int, exclude_self: bool) -> DataFrame:
    """(query_id, id, distance, rank) of pairs of blocks (data, asked)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for have, want in zip(frame["data"], frame["asked"]):
                yield _k_of_block(list(have), list(want), k, exclude_self)

    best = pairs.select("data", "asked").mapInPandas(run, "query_id bigint, id bigint, distance double")
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return best.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", exclude_self: bool = True) -> DataFrame:
    """(query_id, id, distance, rank): the k nearest by squared Euclidean distance, exact; ties by id, fewer if there are fewer.

    The stated queries meet all vectors in blocks: every pair of blocks is one matrix product that keeps k rows a query, and a
    window over these few rows ends it. Vectors that are null or of another length than the query are no neighbours.
    """
    data = _blocks(vectors.where(F.col(vec_col).isNotNull()), id_col, vec_col, BLOCK_ROWS, "data")
    asked = _blocks(queries.where(F.col(vec_col).isNotNull()), id_col, vec_col, QUERY_ROWS, "asked")
    return _best(data.join(asked), k, exclude_self)  # blocks of a stated query set against blocks of all rows


#: The index: at most FIT_ROWS rows fit its cells, of which there are about CELL_ROWS rows each; a query looks into the share PROBED of them, at least LEAST_PROBES.
FIT_ROWS, CELL_ROWS, PROBED, LEAST_PROBES = 20_000, 32, 0.55, 8


def fit_cells(vectors: DataFrame, vec_col: str = "embedding", rounds: int = 8) -> np.ndarray:
    """Centres of the index's cells, by k-means on at most FIT_ROWS vectors chosen by hash (a documented bound); every vector is indexed. One length of vectors alone: the most frequent."""
    have = vectors.where(F.col(vec_col).isNotNull())
    n = have.count()
    size = have.groupBy(F.size(vec_col).alias("d")).count().orderBy(F.desc("count"), "d").first()
    if size is None:
        return np.zeros((0, 0))
    share = min(1.0, FIT_ROWS / n)
    rows = have.where((F.size(vec_col) == size.d) & (F.pmod(F.xxhash64(vec_col), F.lit(1_000_000)) < int(share * 1_000_000))).select(vec_col).limit(2 * FIT_ROWS).toPandas()[vec_col]
    m = np.array(rows.tolist(), dtype=np.float64).reshape(-1, size.d)
    m = m[np.lexsort(m.T)]  # the order of rows does not matter
    cells = max(1, min(len(m), n // CELL_ROWS, 4_096))
    centres = m[np.random.default_rng(3).permutation(len(m))[:cells]]
    for _ in range(rounds):
        at = ((centres * centres).sum(axis=1)[None, :] - 2 * m @ centres.T).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, m)
        counts = np.bincount(at, minlength=len(centres))
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def _in_cells(vectors: DataFrame, centres: np.ndarray, probes: int, id_col: str, vec_col: str) -> DataFrame:
    """(cell, id, v): each vector in its ``probes`` nearest cells."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f = f[[len(v) == centres.shape[1] for v in f["v"]]]
            if not len(f):
                continue
            m = np.array(f["v"].tolist(), dtype=np.float64)
            rough = (centres * centres).sum(axis=1)[None, :] - 2 * m @ centres.T
            near = np.argpartition(rough, min(probes, len(centres)) - 1, axis=1)[:, :probes]
            yield pd.DataFrame({"cell": near.reshape(-1), "id": np.repeat(f["id"].to_numpy(), near.shape[1]), "v": [v for v in f["v"] for _ in range(near.shape[1])]})

    slim = vectors.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    return slim.mapInPandas(run, "cell int, id bigint, v array<double>")


def nearest_indexed(vectors: DataFrame, queries: DataFrame, k: int, centres: np.ndarray, id_col: str = "vec_id", vec_col: str = "embedding", exclude_self: bool = True) -> DataFrame:
    """Like :func:`nearest`, for query sets that grow with the data: a query meets the vectors of its nearest cells alone, so some neighbours are missed (recall is tested to be 0.9 or more).

    Vectors of one cell are cut into blocks of at most about BLOCK_ROWS, so a cell with a third of all rows is many blocks. Vectors of another length than the index's are no neighbours; :func:`nearest` is the exact way.
    """
    if not len(centres):
        return nearest(vectors, queries.limit(0), k, id_col, vec_col, exclude_self)
    probes = min(len(centres), max(LEAST_PROBES, int(PROBED * len(centres))))
    data, asked = _in_cells(vectors, centres, 1, id_col, vec_col), _in_cells(queries, centres, probes, id_col, vec_col)

    def blocks(rows: DataFrame, most: int, name: str) -> DataFrame:
        per = rows.groupBy("cell").agg(F.count("*").alias("n"))  # a row per cell, at most 4,096
        part = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / most))
        return rows.join(F.broadcast(per), "cell").groupBy("cell", part.alias(f"{name}_part")).agg(F.collect_list(F.struct("id", "v")).alias(name))

    return _best(blocks(data, BLOCK_ROWS, "data").join(blocks(asked, QUERY_ROWS, "asked"), "cell"), k, exclude_self)


def expanded(vectors: DataFrame, variants: DataFrame, k: int = 20) -> DataFrame:
    """Search with several variants per query, each for k // N hits; hits are kept with their variant.

    ``variants`` has query_id, vec_id and embedding; the hits of all variants are concatenated.
    """
    n = variants.groupBy("query_id").agg(F.count("*").alias("n"))
    hits = nearest(vectors, variants, k).withColumnRenamed("query_id", "vec_id")
    marked = hits.join(variants.select("query_id", "vec_id"), "vec_id").join(n, "query_id")
    return marked.where(F.col("rank") <= F.floor(F.lit(k) / F.col("n"))).select("query_id", "vec_id", "id", "distance", "rank")


def multi_hop(vectors: DataFrame, queries: DataFrame, k: int = 5, hops: int = 3, decay: float = 0.8, exact: bool = False) -> DataFrame:
    """(query_id, id, hop, relevance): the hits of each hop are the queries of the next; nodes seen before are left out.

    The first hop is exact. Later ones ask with all hits so far, which grow with the data, so they go through an index of cells; ``exact`` asks in blocks against all rows instead.
    """
    from quillon.session import cut_lineage

    seen = front = cut_lineage(nearest(vectors, queries, k).select("query_id", "id").withColumn("hop", F.lit(0)))
    centres = None if exact or hops < 2 else fit_cells(vectors)
    for hop in range(1, hops):
        asked = front.select("id").distinct().withColumnRenamed("id", "vec_id").join(vectors, "vec_id")
        found = nearest(vectors, asked, k) if centres is None else nearest_indexed(vectors, asked, k, centres)
        near = found.select(F.col("query_id").alias("via"), "id")
        step = front.select("query_id", F.col("id").alias("via")).join(near, "via").select("query_id", "id").distinct()
        new = step.where("query_id <> id").join(seen, ["query_id", "id"], "left_anti").withColumn("hop", F.lit(hop))
        front = cut_lineage(new)
        seen = seen.unionByName(front)
    return seen.withColumn("relevance", F.round(F.pow(F.lit(decay), "hop"), 6))


def drop_exact(hits: DataFrame, path: Column, text: Column, order: list[Column], prefix: int = 200) -> DataFrame:
    """The first of the rows that share a path and the beginning of the text."""
    key = F.md5(F.concat_ws(":", path, F.substring(text, 1, prefix)))
    return hits.withColumn("_key", key).withColumn("_n", F.row_number().over(Window.partitionBy("_key").orderBy(*order))).where("_n = 1").drop("_n", "_key")


# ---------------------------------------------------------------- features and rank


def features(text: Column, path: Column, query: Column, entities: Column | None = None) -> dict[str, Column]:
    """Five features of a hit, each between 0 and 1."""
    low, low_path, q = F.lower(text), F.lower(path), F.lower(query)
    terms = token_set(query)
    share = F.when(F.size(terms) == 0, 0.0).otherwise(F.size(F.array_intersect(terms, token_set(text))) / F.size(terms))
    relevance = F.least(F.lit(1.0), share + F.when(low.contains(q), 0.5).otherwise(0.0))
    coverage = F.lit(0.5)
    if entities is not None:
        per = F.transform(entities, lambda e: F.when(low.contains(F.lower(e["text"])), e["confidence"]).otherwise(0.0) + F.when(F.exists(e["aliases"], lambda a: low.contains(F.lower(a))), e["confidence"] * 0.5).otherwise(0.0))
        coverage = F.when(F.size(entities) > 0, F.least(F.lit(1.0), F.aggregate(per, F.lit(0.0), lambda a, x: a + x) / F.size(entities))).otherwise(0.5)
    has = lambda p, w: F.when(low.rlike(p), w).otherwise(0.0)
    quality = F.lit(0.5) + has(r"def\s+\w+\s*\(", 0.1) + has(r"class\s+\w+", 0.1) + has(r"import\s+\w+", 0.05) + has(r'(?s)""".*?"""', 0.1) + has(r"#\s*\w+", 0.05)
    quality = quality * F.when(F.length(text) < 50, 0.5).when(F.length(text) > 2000, 0.8).otherwise(1.0)
    structural = F.lit(0.5) + F.when(low_path.rlike(r"\.(py|js|java)$"), 0.2).when(low_path.rlike(r"\.(md|txt|rst)$"), 0.1).otherwise(0.0) + F.when(low_path.rlike("src|core|api|routes|models|services"), 0.1).otherwise(0.0)
    return {"text_relevance": relevance, "entity_coverage": coverage, "code_quality": F.least(F.lit(1.0), quality), "freshness": F.lit(0.5), "structural": F.least(F.lit(1.0), structural)}


#: Weights of the features.
WEIGHTS = {"text_relevance": 0.3, "entity_coverage": 0.3, "code_quality": 0.2, "freshness": 0.1, "structural": 0.1}


def final_score(parts: dict[str, Column], prior: Column | None = None) -> Column:
    """Weighted sum; blended 0.7 to 0.3 with a prior score where there is one."""
    new = sum(parts[k] * w for k, w in WEIGHTS.items())
    return new if prior is None else F.when(prior.isNotNull(), 0.7 * new + 0.3 * prior).otherwise(new)


# ---------------------------------------------------------------- greedy selection within one query's hits


def _sets(texts) -> list[frozenset]:
    return [frozenset((t or "").lower().split()) for t in texts]


def _similarity(a: frozenset, b: frozenset) -> float:
    return len(a & b) / len(a | b) if a and b else 0.0


def greedy_unique(texts: list[str], threshold: float = 0.7) -> list[int]:
    """Indexes kept in order: each is at most ``threshold`` similar to all kept before it."""
    sets, kept = _sets(texts), []
    for i, s in enumerate(sets):
        if all(_similarity(s, sets[j]) <= threshold for j in kept):
            kept.append(i)
    return kept


def greedy_clusters(texts: list[str], path: list[str], least: float = 0.5) -> list[int]:
    """For each row the index of its cluster's leader: same path, or half of the smaller token set shared."""
    sets, leaders, out = _sets(texts), [], []
    for i, s in enumerate(sets):
        hit = next((j for j in leaders if path[i] == path[j] or s and sets[j] and len(s & sets[j]) / min(len(s), len(sets[j])) > least), None)
        if hit is None:
            leaders.append(i)
        out.append(i if hit is None else hit)
    return out


def diverse(texts: list[str], k: int, mode: str = "min") -> list[int]:
    """The first row, then again and again the row whose least (or, with ``mode='mmr'``, largest) similarity to the chosen is smallest."""
    sets, left = _sets(texts), list(range(len(texts)))
    chosen = [left.pop(0)] if left else []
    pick = min if mode == "min" else max
    while left and len(chosen) < k:
        best = max(left, key=lambda i: (1 - pick(_similarity(sets[i], sets[j]) for j in chosen), -i))
        left.remove(best)
        chosen.append(best)
    return chosen


MAX_HITS = 1_000


def select_hits(hits: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, id, path, place, cluster): near-duplicates dropped, clustered and varied, per query.

    ``hits`` has query_id, id, path, text and score. A query's hits come from a top-k search, so a group is small; a group of more than MAX_HITS rows is an error.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        if len(frame) > MAX_HITS:
            raise ValueError(f"more than {MAX_HITS} hits for a query")
        frame = frame.sort_values(["score", "id"], ascending=[False, True]).reset_index(drop=True)
        frame = frame.iloc[greedy_unique(frame["text"].tolist())].reset_index(drop=True)
        leader = greedy_clusters(frame["text"].tolist(), frame["path"].tolist()) if len(frame) > 10 else list(range(len(frame)))
        order = diverse(frame["text"].tolist(), k)
        return pd.DataFrame({"query_id": frame["query_id"].iloc[order].to_numpy(), "id": frame["id"].iloc[order].to_numpy(), "path": frame["path"].iloc[order].to_numpy(), "place": range(1, len(order) + 1), "cluster": [frame["id"].iloc[leader[i]] for i in order]})

    return hits.select("query_id", "id", "path", "text", "score").groupBy("query_id").applyInPandas(run, "query_id bigint, id bigint, path string, place int, cluster bigint")


# ---------------------------------------------------------------- queries in words

#: Forms that name code elements, and the words that route a question.
ENTITY_PATTERNS = {
    "technologies": r"(?:from|import)\s+([a-zA-Z_][\w\.]*)", "classes": r"class\s+([A-Z]\w*)", "functions": r"def\s+([a-z_]\w*)", "variables": r"([a-z_]\w*)\s*=", "files": r"""['"]([^'"\s]+\.[a-z]+)['"]""",
    "urls": r"(https?://[^\s]+)", "endpoints": r"""['"]([/][\w/\-{}]+)['"]""",
}


def entities(texts: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(id, type, text, n): code elements named in a text."""
    one = lambda kind, p: texts.select(id_col, F.lit(kind).alias("type"), F.explode(F.regexp_extract_all(text, F.lit(p), 1)).alias("text"))
    out = None
    for kind, pattern in ENTITY_PATTERNS.items():
        part = one(kind, pattern)
        out = part if out is None else out.unionByName(part)
    return out.groupBy(id_col, "type", "text").agg(F.count("*").alias("n"))


def aliases(found: DataFrame, id_col: str) -> DataFrame:
    """(id, text, alias): other entities of the same text that are its lower-case or snake-case form."""
    from quillon.functions.text import snake_case

    forms = found.select(id_col, F.col("text").alias("a"), F.explode(F.array_distinct(F.array(F.lower("text"), snake_case(F.col("text"))))).alias("form"))
    other = found.select(id_col, F.lower("text").alias("form"), F.col("text").alias("b"))
    return forms.join(other, [id_col, "form"]).where("a <> b").select(id_col, F.col("a").alias("text"), F.col("b").alias("alias")).distinct()


def route(question: Column) -> Column:
    """The search strategy a question calls for."""
    low = F.lower(question)
    words = F.size(F.filter(F.split(question, r"\s+"), lambda w: w != ""))
    return (
        F.when(low.rlike("how does|workflow|process|trace"), "multi_hop").when(low.rlike("impact|depends|affects|uses"), "graph_guided").when(words > 15, "hybrid").otherwise("expanded")
    )


def expansions(question: Column, names: Column, most: int = 5) -> Column:
    """Distinct variants of a question, in order: itself, then two templates for each of the first two names."""
    first = F.slice(names, 1, 2)
    more = F.flatten(F.transform(first, lambda n: F.array(F.concat(n, F.lit(" implementation")), F.concat(F.lit("usage of "), n))))
    return F.slice(F.filter(F.array_distinct(F.concat(F.array(question), more)), lambda q: F.length(q) > 3), 1, most)


def ranked(variants: DataFrame, question: Column) -> DataFrame:
    """(doc_id, place, variant, score): variants by the Jaccard similarity of their words to the question, ties in the order given, duplicates kept."""
    a, b = token_set(F.col("variant")), token_set(question)
    union = F.size(F.array_union(a, b))
    scored = variants.withColumn("score", F.when(union > 0, F.round(F.size(F.array_intersect(a, b)) / union, 6)).otherwise(0.0))
    order = Window.partitionBy("doc_id").orderBy(F.desc("score"), "place")
    return scored.withColumn("at", F.row_number().over(order).cast("bigint") - 1).select("doc_id", F.col("at").alias("place"), "variant", "score")


def context(hits: DataFrame, per_file: int = 5) -> DataFrame:
    """(query_id, context): the first hits of each file, files in order of their best hit."""
    order = Window.partitionBy("query_id", "path").orderBy(F.desc("score"), "id")
    top = hits.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_file)
    files = top.groupBy("query_id", "path").agg(F.max("score").alias("best"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda s: s["text"]), "\n").alias("body"))
    block = F.concat(F.lit("## "), F.col("path"), F.lit("\n"), F.col("body"))
    return files.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("best")).alias("b"), "path", block.alias("t")))), lambda s: s["t"]), "\n\n").alias("context"))


def concepts(question: Column, most: int = 3) -> Column:
    """The first concepts of a question: each word of more than four characters, before it with its neighbour if that has more than three."""
    words = F.filter(F.split(F.lower(question), r"\s+"), lambda w: w != "")

    def found(ws: Column) -> Column:
        pair = lambda w, i: F.when((F.length(w) > 4) & (F.length(F.get(ws, i + 1)) > 3), F.concat(w, F.lit(" "), F.get(ws, i + 1)))
        both = F.transform(ws, lambda w, i: F.array(pair(w, i), F.when(F.length(w) > 4, w)))
        return F.slice(F.array_compact(F.flatten(both)), 1, most)

    return F.transform(F.array(words), found)[0]  # the words are split once


#: What is asked for besides, where a question has a word.
CODE_WORDS = {"api": ["API routes", "endpoint definitions", "REST endpoints"], "database": ["schema", "models", "queries"], "test": ["unit tests", "test cases", "test fixtures"]}
#: What the hops of a search ask about a name.
HOP_FORMS = [["implementation of {}", "{} definition"], ["calls to {}", "{} dependencies"], ["related to {}"]]


def wide_expansions(question: Column, names: Column, most: int = 5) -> Column:
    """Variants of a question by its names, its concepts and its words on code, ranked by the share of words that they have in common with it; ties keep their order, at most twice ``most``."""
    about = F.flatten(F.transform(concepts(question), lambda c: F.array(F.concat(F.lit("examples of "), c), F.concat(c, F.lit(" pattern")), F.concat(F.lit("best practices for "), c))))
    code = F.flatten(F.array(*[F.when(F.lower(question).contains(w), F.array(*[F.lit(x) for x in xs])).otherwise(F.array().cast("array<string>")) for w, xs in CODE_WORDS.items()]))
    every = F.concat(expansions(question, names, most), about, code)
    own = token_set(question)
    scored = F.transform(every, lambda v, i: F.struct((-F.size(F.array_intersect(token_set(v), own)) / F.greatest(F.size(F.array_union(token_set(v), own)), F.lit(1))).alias("s"), i.alias("i"), v.alias("v")))
    return F.slice(F.transform(F.array_sort(scored), lambda x: x["v"]), 1, 2 * most)


def hop_questions(question: Column, names: Column, hop: int, most: int = 5) -> Column:
    """What a hop of a search asks: the question itself, then forms of its first names (three in the second hop, else two)."""
    if hop == 0:
        return F.array(question)
    forms = HOP_FORMS[min(hop, 3) - 1]
    made = F.transform(F.slice(names, 1, 3 if hop == 1 else 2), lambda n: F.array(*[F.concat(F.lit(f.split("{}")[0]), n, F.lit(f.split("{}")[1])) for f in forms]))
    return F.slice(F.flatten(made), 1, most)


def embed(texts: DataFrame, model, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, embedding) by a model of the caller's, a function from a list of texts to rows of numbers; it is called once per batch of rows on the workers. Null texts are embedded as empty ones."""
    import pyarrow as pa

    kind = dict(texts.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = model([t or "" for t in b.column(1).to_pylist()]) if b.num_rows else []
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([[float(x) for x in v] for v in made], pa.list_(pa.float32()))], [id_col, "embedding"])

    return texts.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, embedding array<float>")


# ---------------------------------------------------------------- strategies put together


def graph_guided(scored: DataFrame, question: str, vectors: DataFrame, model, k: int = 5) -> DataFrame:
    """(repo_id, node_id, id, distance, rank): the nodes that a question points at, each asked for together with the question, and the k nearest texts of each.

    ``scored`` are the few nodes of :func:`node_scores`, so the question set is a top-k report; ``model`` embeds the questions like the ``vectors`` were.
    """
    asked = scored.select("repo_id", "node_id").distinct().withColumn("id", F.xxhash64("repo_id", "node_id")).withColumn("text", F.concat(F.regexp_extract("node_id", r"([^/]*)$", 1), F.lit(" in "), F.col("node_id"), F.lit(" " + question)))
    questions = embed(asked, model).withColumnRenamed("id", "vec_id")
    hits = nearest(vectors, questions, k, exclude_self=False)
    return hits.join(asked.select(F.col("id").alias("query_id"), "repo_id", "node_id"), "query_id").select("repo_id", "node_id", "id", "distance", "rank")


def node_scores(nodes: DataFrame, names: list[tuple], most: int = 10) -> DataFrame:
    """(repo_id, node_id, score, rank): how much of a question's named elements a node's id and name contain; zero scores are left out.

    ``names`` are the few (text, confidence) or (text, confidence, aliases) of one question, so they are constants of the expression and no join is needed.
    """
    low = F.lower("node_id")
    name = F.lower(F.regexp_extract("node_id", r"([^/]*)$", 1))
    score = F.lit(0.0)
    for text, confidence, *aliases in names:
        for alias in aliases[0] if aliases else ():
            score = score + F.when(low.contains(alias.lower()), 0.5 * confidence).otherwise(0.0)
        score = score + F.when(low.contains(text.lower()), 2.0 * confidence).otherwise(0.0) + F.when(name.contains(text.lower()), confidence).otherwise(0.0)
    order = Window.partitionBy("repo_id").orderBy(F.desc("score"), "node_id")
    found = nodes.select("repo_id", "node_id", F.round(score, 6).alias("score")).where("score > 0").distinct()
    return found.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= most)


def hybrid(*parts: tuple[str, DataFrame]) -> DataFrame:
    """(query_id, id, n_strategies, strategies) over the hits of several strategies, each hit once."""
    every = None
    for name, hits in parts:
        one = hits.select("query_id", "id").withColumn("strategy", F.lit(name))
        every = one if every is None else every.unionByName(one)
    return every.groupBy("query_id", "id").agg(F.countDistinct("strategy").alias("n_strategies"), F.array_join(F.array_sort(F.collect_set("strategy")), ",").alias("strategies"))


def exemplars(hits: DataFrame, keep: Column) -> DataFrame:
    """The best hit of every file that ``keep`` admits, per query."""
    order = Window.partitionBy("query_id", "path").orderBy(F.desc("score"), "id")
    return hits.where(keep).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def answer_confidence(hits: DataFrame, most: int = 5) -> DataFrame:
    """(query_id, n_hits, confidence): the mean score of the first hits, held between 0.3 and 0.9."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    top = hits.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most)
    return top.groupBy("query_id").agg(F.count("*").alias("n_hits"), F.round(F.least(F.lit(0.9), F.greatest(F.lit(0.3), F.avg("score"))), 6).alias("confidence"))


def readiness(repos: DataFrame, vectors: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo_id, status): excellent with an index and a graph, good with one of them, else poor."""
    v = vectors.select("repo_id").distinct().withColumn("v", F.lit(True))
    e = edges.select("repo_id").distinct().withColumn("e", F.lit(True))
    both = repos.select("repo_id").distinct().join(v, "repo_id", "left").join(e, "repo_id", "left")
    return both.select("repo_id", F.when(F.col("v") & F.col("e"), "excellent").when(F.coalesce("v", "e"), "good").otherwise("poor").alias("status"))


def function_names(text: Column) -> Column:
    """Distinct names of functions in Python and JavaScript text, sorted."""
    python = F.regexp_extract_all(text, F.lit(r"def\s+([a-zA-Z_]\w*)\s*\("), 1)
    script = F.regexp_extract_all(text, F.lit(r"function\s+([a-zA-Z_]\w*)\s*\("), 1)
    return F.array_sort(F.array_distinct(F.concat(python, script)))


def all_function_names(text: Column) -> Column:
    """Those of function_names, with Class.method for the first method behind each class and the handlers of routes, sorted."""
    methods = F.lit(r"(?s)class\s+(\w+).*?def\s+([a-zA-Z_]\w*)")
    named = F.zip_with(F.regexp_extract_all(text, methods, 1), F.regexp_extract_all(text, methods, 2), lambda c, m: F.concat(c, F.lit("."), m))
    routes = F.regexp_extract_all(text, F.lit(r"""(?s)@app\.route\(['"]([^'"]+)['"].*?\ndef\s+([a-zA-Z_]\w*)"""), 2)
    return F.array_sort(F.array_distinct(F.concat(function_names(text), named, routes)))


def start_nodes(hits: DataFrame) -> DataFrame:
    """(query_id, node, path, id, confidence): the function named in the best hit that names one; ties by id and name."""
    named = hits.select("query_id", "path", "id", F.col("score").alias("confidence"), F.explode(all_function_names(F.col("text"))).alias("node"))
    order = Window.partitionBy("query_id").orderBy(F.desc("confidence"), "id", "node")
    return named.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("query_id", "node", "path", "id", "confidence")

"""Parts of the searches: variants in order, names of methods and routes, start nodes, expanded hits."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillon.operators import retrieval as R

D = "/root/testdata/sf0.001"


def test_ranked(spark):
    rows = [(1, 0, "x implementation"), (1, 1, "usage of cache"), (1, 2, "the cache"), (1, 3, "the cache")]
    got = R.ranked(spark.createDataFrame(rows, "doc_id bigint, place bigint, variant string"), F.lit("retry the cache")).orderBy("place").collect()
    assert [r.variant for r in got] == ["the cache", "the cache", "usage of cache", "x implementation"] and [r.score for r in got] == [0.666667, 0.666667, 0.2, 0.0]


def test_names_and_start(spark):
    text = "class A:\n    x = 1\n    def go(self):\n        pass\n@app.route('/a', methods=['GET'])\ndef\tshow[T](x): pass\nfunction js(a) {}\n"
    hits = spark.createDataFrame([(7, "p", 1, 0.9, "no names"), (7, "q", 2, 0.8, text), (7, "r", 3, 0.1, "def z("), (8, "r", 3, 0.1, None)], "query_id bigint, path string, id bigint, score double, text string")
    assert hits.where("id = 2").select(R.all_function_names(F.col("text"))).first()[0] == ["A.go", "go", "js", "show"]
    assert [tuple(r) for r in R.start_nodes(hits).collect()] == [(7, "A.go", "q", 2, 0.8)]


def test_aliases_count(spark):
    nodes = spark.createDataFrame([("r", "src/session_cache.py")], "repo_id string, node_id string")
    assert R.node_scores(nodes, [("sessioncache", 0.8, ["session_cache", "none"])]).first().score == 0.4


def test_blocks_are_exact(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(R, "BLOCK_ROWS", 40)
    monkeypatch.setattr(R, "QUERY_ROWS", 7)
    r = np.random.default_rng(2)
    m = np.round(r.normal(size=(300, 5)) * 2) / 2  # many ties
    v = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(m)] + [(900, None), (901, [1.0])], "vec_id bigint, embedding array<float>").cache()
    got = {}
    for x in R.nearest(v, v.where("vec_id % 20 = 0"), 6).collect():
        got.setdefault(x.query_id, []).append((x["rank"], x.distance, x.id))
    for q in range(0, 300, 20):
        want = sorted((round(float(((m[i] - m[q]) ** 2).sum()), 6), i) for i in range(300) if i != q)[:6]
        assert [(d, i) for _, d, i in sorted(got[q])] == want


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_recall_of_the_index(spark):
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").cache()
    asked = v.where("vec_id % 20 = 0")
    exact = {(r.query_id, r.id) for r in R.nearest(v, asked, 5).collect()}
    found = {(r.query_id, r.id) for r in R.nearest_indexed(v, asked, 5, R.fit_cells(v)).collect()}
    assert len(exact & found) >= 0.9 * len(exact)
    assert R.nearest_indexed(v.limit(0), asked, 5, R.fit_cells(v.limit(0))).count() == 0


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
def test_hybrid_has_expanded(spark):
    hybrid = entry.queries()["hybrid_search"](spark, D)
    own = entry.queries()["expanded_search"](spark, D)
    have = {(r.query_id, r.id): r.strategies.split(",") for r in hybrid.collect()}
    asked = {(r.query_id, r.id) for r in own.collect() if r.query_id != r.id}
    assert asked and all("expanded" in have[k] for k in asked)


def test_wide_expansions_and_hops(spark):
    df = spark.createDataFrame([(1, "retry the session cache of the api test", ["load", "save"]), (2, "a b", []), (3, "", [])], "doc_id bigint, q string, names array<string>")
    rows = {r.doc_id: r for r in df.select("doc_id", R.concepts(F.col("q")).alias("c"), R.wide_expansions(F.col("q"), F.col("names")).alias("w"), R.hop_questions(F.col("q"), F.col("names"), 1).alias("h1"), R.hop_questions(F.col("q"), F.col("names"), 3).alias("h3")).collect()}
    assert rows[1].c == ["retry", "session cache", "session"] and rows[2].c == [] and rows[3].w == []
    assert rows[1].w[0] == "retry the session cache of the api test" and len(rows[1].w) == 10 and "examples of session cache" in rows[1].w
    assert rows[1].h1 == ["implementation of load", "load definition", "implementation of save", "save definition"] and rows[1].h3 == ["related to load", "related to save"]


def test_graph_guided(spark):
    model = lambda texts: [[float(t.count("a")), float(t.count("b"))] for t in texts]
    docs = R.embed(spark.createDataFrame([(1, "aaa"), (2, "bbb"), (3, None)], "vec_id bigint, text string"), model, "vec_id")
    assert [list(r.embedding) for r in docs.orderBy("vec_id").collect()] == [[3.0, 0.0], [0.0, 3.0], [0.0, 0.0]]
    nodes = spark.createDataFrame([("r", "x/aa", 1.0)], "repo_id string, node_id string, score double")
    got = R.graph_guided(nodes, "q", docs, model, 2).orderBy("rank").collect()
    assert [(r.node_id, r.id) for r in got] == [("x/aa", 1), ("x/aa", 3)]

import json

import pytest
from pyspark.sql import functions as F

from quillon.functions import paths, text
from quillon.operators import chunking, diffs, expertise, files, graph, retrieval, series, supply
from quillon.sources import manifests, stores, tree
from quillon.streaming import metrics as stream


def one(spark, value, make):
    """The value of a column function on one string."""
    return spark.createDataFrame([(value,)], "v string").select(make(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(("path", "want"), [
    ("a/b.PY", ("python", "Python", "backend")), ("x/Dockerfile", ("unknown", "No Extension", "infrastructure")), ("t/tests/a.js", ("javascript", "JavaScript", "testing")), (".env", ("unknown", "No Extension", "other")),
    ("a.tar.zz", ("unknown", "Unknown (.zz)", "other")), ("", ("unknown", "No Extension", "other")), ("Cargo.toml", ("unknown", "TOML", "build")),
])
def test_paths(spark, path, want):
    assert one(spark, path, lambda c: F.array(paths.language(c), paths.display_language(c), paths.category(c))) == list(want)


@pytest.mark.parametrize(("value", "tokens", "lines"), [("a b\u00a0c\n", 3, 1), ("", 0, 0), ("a\nb", 2, 2), ("\n\n", 0, 2), (None, 0, 0)])
def test_counts(spark, value, tokens, lines):
    assert one(spark, value, lambda c: F.array(text.token_count(c), text.line_count(c).cast("int"))) == [tokens, lines]


def test_text_functions(spark):
    assert one(spark, "ab_CdEf", text.snake_case) == "ab__cd_ef" and one(spark, "parseHTTPCode", text.snake_case) == "parse_http_code" and one(spark, "a_bc", text.camel_case) == "ABc"
    assert one(spark, "jo.o_neil-x@y.z", text.name_from_email) == "Jo O Neil X"
    assert one(spark, "/a/<str:id>/<n>/<int:k>", text.path_template) == "/a/{id}/{n}/<int:k>"
    assert one(spark, "Fix: the  Thing!", text.branch_name) == "fix-the-thing"
    assert one(spark, "```py\nx = 1\n```", text.strip_fences) == "x = 1"
    assert one(spark, "^1.2", text.version_core) == "1.2" and one(spark, "any", text.version_core) is None
    assert json.loads(one(spark, "<think>[1]</think> so ```json\n{\"a\": [1]}\n``` end", text.embedded_json)) == {"a": [1]}
    assert one(spark, "none", text.embedded_json) is None
    assert one(spark, "0123456789", lambda c: text.context_window(c, F.lit("5"), 2)) == "34567"
    assert one(spark, "a B c", lambda c: text.jaccard(text.token_set(c), text.token_set(F.lit("b c d")))) == 0.5
    assert one(spark, "", lambda c: text.overlap(text.token_set(c), text.token_set(F.lit("b")))) == 0


def test_smells_and_scan(spark):
    assert one(spark, "from a import *\nexcept:\n# TODO token", lambda c: files.smells(c, F.lit("python"))) == ["wildcard_import", "bare_except", "potential_token_exposure", "potential_todo_exposure"]
    rows = [("src/__init__.py",), ("node_modules/a.py",), (".git/x.py",), ("a/.hid.py",), ("b/c.txt",), ("Dockerfile",), (None,)]
    df = spark.createDataFrame(rows, "file_path string")
    assert {r.file_path for r in files.scan_filter(df, ["*.py", "Dockerfile"]).collect()} == {"src/__init__.py", "Dockerfile"}
    assert {r.file_path for r in files.scan_filter(df, ["*.py"], [], True).collect()} == {"src/__init__.py", "node_modules/a.py", ".git/x.py", "a/.hid.py"}


def test_find_by_name(spark):
    df = spark.createDataFrame([("r", "a/x.js"), ("r", "b/x.js"), ("s", "x.js"), ("s", "a/x.js"), ("t", "q/x.js")], "repo_id string, file_path string")
    got = {r.repo_id: (r.status, r.file_path) for r in files.find_by_name(df, "x.js").collect()}
    assert got == {"r": ("ambiguous", None), "s": ("found", "x.js"), "t": ("found", "q/x.js")}


def test_experts(spark):
    rows = [("r", "f", "a.b@x", 50), ("r", "f", "a.b@x", 50), ("r", "f", "c@x", 25), ("r", "f", None, 25), ("r", "g", "z@x", 0)]
    got = {(r.file_path, r.email): r for r in expertise.file_experts(spark.createDataFrame(rows, "repo_id string, file_path string, email string, line_count bigint")).collect()}
    assert got["f", "a.b@x"].score == 90 and got["f", "a.b@x"].rank == 1 and got["f", expertise.NOBODY].share == 25 and got["g", "z@x"].score == 0


def test_series(spark):
    rows = [("r", 1, "m", 0.0, 1), ("r", 2, "m", 5.0, 2), ("r", 3, "m", 10.0, 3), ("r", 3, "m", 9.0, 1), ("r", 4, "m", None, 4), ("r", 5, "m", -5.0, 5)]
    df = spark.createDataFrame(rows, "repo_id string, s int, metric string, value double, l int").selectExpr("repo_id", "timestamp_seconds(s) ts", "metric", "value", "timestamp_seconds(l) loaded_at")
    got = [r.change_pct for r in series.changes(df).orderBy("ts").collect()]
    assert got == [None, None, 100.0, -150.0]
    assert series.latest_changes(df).first().change_pct == -150.0


def test_supply(spark):
    raw = spark.createDataFrame([
        ("pypi", "a", "1", json.dumps({"severity": [{"type": "CVSS_V3", "score": 9.0}], "affected": [{"versions": ["1.0"], "ranges": [{"events": [{"introduced": "0"}, {"fixed": "1.1"}]}]}]})),
        ("pypi", "a", "2", json.dumps({"database_specific": {"severity": "LOW"}, "affected": [{"versions": ["1.0", "2.0"]}]})), ("pypi", "b", "3", "{}"), ("pypi", "b", "4", "not json"),
    ], "ecosystem string, name string, advisory_id string, raw string")
    known = {r.advisory_id: r for r in supply.advisories(raw).collect()}
    assert known["1"].severity == "critical" and known["1"].fixed_versions == ["1.1"] and known["2"].severity == "low" and known["3"].severity == "medium"
    deps = spark.createDataFrame([("r", "a", "^1.0", "application", "PyPI", "MIT", None), ("r", "a", "^1.0", "application", "PyPI", "MIT", None), ("r", "c", "any", "x", "npm", None, True), ("r", "d", "1", "x", "npm", "GPL-3.0", None), ("r", "e", "1", "x", "npm", "Foo", None)], "repo_id string, name string, version string, dependency_type string, ecosystem string, license string, deprecated boolean")
    found = supply.vulnerable(deps, supply.advisories(raw))
    assert {r.advisory_id for r in found.collect()} == {"1", "2"} and supply.security_health(found).first().security_health == 59
    kinds = {r.name: r.violation_type for r in supply.violations(deps, supply.default_policy(spark)).collect()}
    assert kinds == {"c": "unknown", "d": "denied", "e": "not_allowed"}
    assert one(spark, "my-Redis:7", supply.service_type) == "cache" and one(spark, "x", supply.service_type) == "application"


EDGES = "repo_id string, seq bigint, source string, target string, type string"


def test_graph(spark):
    rows = [("r", 1, "a", "b", "IMPORTS"), ("r", 2, "a", "b", "CALLS"), ("r", 3, "b", "c", "CALLS"), ("r", 4, "c", "a", "CALLS"), ("r", 5, "a", "d", "CALLS"), ("r", 6, "d", "d", "CALLS"), ("s", 1, "x", "y", "CALLS")]
    e = spark.createDataFrame(rows, EDGES)
    assert {(r.source, r.target): r.type for r in graph.collapse(e).where("repo_id = 'r'").collect()}["a", "b"] == "CALLS"
    seeds = spark.createDataFrame([("r", "a"), ("s", "z")], "repo_id string, seed string")
    assert {(r.node, r.depth) for r in graph.reach(e, seeds, 2).where("repo_id = 'r'").collect()} == {("a", 0), ("b", 1), ("d", 1)}
    assert {r.node for r in graph.reach(e, seeds, 9, inclusive=True).where("repo_id = 'r'").collect()} == {"a", "b", "c", "d"}
    blast = {r.repo_id: (r.n_upstream, r.n_downstream, r.n_affected) for r in graph.blast_radius(e, seeds).collect()}
    assert blast == {"r": (2, 1, 4), "s": (0, 0, 1)}
    nodes = spark.createDataFrame([("r", n) for n in "abcd"] + [("s", "x"), ("s", "y")], "repo_id string, node string")
    assert {(r.node, r.level) for r in graph.topological_levels(e, nodes).collect()} == {("x", 0), ("y", 1)}
    steps = [tuple(r)[3:] for r in graph.trace(e, seeds, 4).orderBy("step").collect()]
    # by hand: a-b, b-c, c-a (back to a), a-d, d-d (back to d)
    assert steps == [("a", "b", 1, False), ("b", "c", 2, False), ("c", "a", 3, False), ("c", "a", 3, True), ("a", "d", 1, False), ("d", "d", 2, False), ("d", "d", 2, True)]
    stats = graph.trace_stats(graph.trace(e, seeds, 4)).first()
    assert stats.n_steps == 7 and stats.has_recursion and stats.nodes_visited == 4
    assert graph.trace(e, seeds.limit(0)).count() == 0 and graph.reach(e.limit(0), seeds, 3).count() == 2


DIFF = """diff --git a/old name.py b/old name.py
--- a/old name.py
+++ b/old name.py
@@ -1,2 +1,3 @@
 x
+y
-z
@@ -9 +10,0 @@
-q
diff --git a/n.py b/n.py
new file mode 100644
--- /dev/null
+++ b/n.py
@@ -0,0 +1,2 @@
+a
+b
diff --git a/d.py b/d.py
deleted file mode 100644
--- a/d.py
+++ /dev/null
@@ -1 +0,0 @@
-a
"""


def test_diffs(spark):
    h = diffs.hunks(spark.createDataFrame([("1", DIFF), ("2", None), ("3", "no diff")], "diff_id string, diff_text string"))
    got = {(r.file_path, r.hunk): (r.status, r.added, r.removed, r.start, r.len) for r in h.collect()}
    assert got["old name.py", 0] == ("modified", 1, 2, 1, 3) and got["old name.py", 1][3:] == (10, 0) and got["n.py", 0][0] == "added" and got["d.py", 0][0] == "deleted"
    spans = spark.createDataFrame([("old name.py", "s1", 3, 5), ("old name.py", "s2", 4, 9), ("old name.py", "s3", 10, 11), ("n.py", "s4", 50, 60)], "file_path string, span_id string, start_line int, end_line int")
    assert {(r.span_id, r.change) for r in diffs.routed(h, spans, ["file_path"]).collect()} == {("s1", "modified"), ("s4", "added")}
    assert {r.file_path for r in diffs.unknown_files(h, spans, ["file_path"]).collect()} == {"d.py"}
    t = diffs.totals(h).first()
    assert (t.n_files, t.added, t.removed, t.n_new, t.n_deleted) == (3, 3, 3, 1, 1)
    with pytest.raises(Exception, match="span starts"):
        diffs.checked_spans(spans.withColumn("end_line", F.lit(1))).collect()


def test_chunking():
    code = "import os\n\nX = 1\n\nclass A:\n    def m(self):\n        return 1\n\nasync def f():\n    pass\n"
    got = [(k, n, a, b) for _, k, n, a, b in chunking.chunk(code, "python")]
    assert [g for g in got if g[0] != "code_block"] == [("import_statement", None, 1, 1), ("class_definition", "A", 5, 7), ("function_definition", "m", 6, 7), ("function_definition", "f", 9, 10)]
    assert [g for g in got if g[0] == "code_block"] == [("code_block", None, 2, 4)]
    go = [(k, n, a, b) for _, k, n, a, b in chunking.chunk("package a\n\nfunc F(x int) {\n\treturn\n}\n\ntype T struct {\n}\n", "go")]
    assert go == [("code_block", None, 1, 2), ("function_definition", "F", 3, 5), ("struct_definition", "T", 7, 8)]
    assert [c[3:] for c in chunking.chunk("a\nb\n\nc\n\n\n\nd", "unknown")] == [(1, 2), (4, 4), (7, 7)]
    assert [c[1:] for c in chunking.chunk("x\n" * 5, "unknown")] == [("paragraph", None, 1, 6)] and [c[1:] for c in chunking.chunk(" \n" * 25, "unknown")] == [("line_group", None, 1, 10), ("line_group", None, 11, 20), ("line_group", None, 21, 25)]
    assert chunking.chunk("", "go") == [] and [c[1:3] for c in chunking.chunk("import a\ndef f(:\n  x\nclass B:\n", "python")] == [("import_definition", None), ("function_definition", "f"), ("class_definition", "B")]


def test_chunk_places():
    js = "// top\nfunction a() {\n}\nlet x = 1;\n}\nclass B {\n  m() {}\n}\n}\nimport z\n"
    assert [(k, n, a, b) for _, k, n, a, b in chunking.chunk(js, "javascript")] == [("code_block", None, 1, 1), ("function_definition", "a", 2, 3), ("code_block", None, 4, 5), ("class_definition", "B", 6, 8), ("code_block", None, 9, 9), ("import_definition", None, 10, 10)]
    php = "<?php\nfunction a() {\n}\n$x = 1;\n"  # no end at a brace
    assert [(k, n, a, b) for _, k, n, a, b in chunking.chunk(php, "php")] == [("code_block", None, 1, 1), ("function_definition", "a", 2, 4)]
    assert [c[3:] for c in chunking.chunk("func A() {\r\n}\r\x0cfunc B() {}", "go")] == [(1, 2), (3, 4)] or [c[3:] for c in chunking.chunk("func A() {\r\n}\r\x0cfunc B() {}", "go")] == [(1, 2), (4, 4)]
    nested = "class A:\n    def m(self):\n        pass\n    x = 1\ny = 2\n"
    assert [(k, a, b) for _, k, _, a, b in chunking.chunk(nested, "python")] == [("class_definition", 1, 4), ("function_definition", 2, 3), ("code_block", 4, 5)]
    assert chunking.by_patterns("", "go") == [] and chunking.by_paragraphs("") == []


@pytest.mark.parametrize(("code", "want"), [
    ("@app.route('/a', methods=['POST', 'GET'])\ndef f():\n", ("/a", ["POST", "GET"], "f", "Flask")), ("@router.get('/b')\nasync def g():\n", ("/b", ["GET"], "g", "FastAPI")), ("path('c/', views.h)", ("c/", ["GET", "POST"], "views", "Django")),
    ('app.post("/d", handler)', ("/d", ["POST"], "handler", "Express")), ('app.get("/e", (q, r) => {', ("/e", ["GET"], "anonymous_express_0", "Express")), ('@GetMapping("/f")\npublic String g() {', ("/f", ["GET"], "g", "Spring")),
    ('router.PUT("/h", up)', ("/h", ["PUT"], "up", "Gin")), ("Route::delete('/i', 'C@d')", ("/i", ["DELETE"], "C@d", "Laravel")), ("get '/j', to: 'c#x'", ("/j", ["GET"], "c#x", "Rails")),
])
def test_endpoints(code, want):
    path, methods, handler, first, last, framework = chunking.endpoints_of("\n" * 3 + code)[0]
    assert (path, methods, handler.replace("_3", "_0"), framework) == want and first == 4 and last == 4 + code.rstrip("\n").count("\n")


def test_view_classes():
    code = "class V(views.APIView):\n    pass\n\n@api_view(['GET', 'POST'])\ndef v(request): pass\n"
    assert chunking.endpoints_of(code) == [] and [(x[1], x[2], x[3], x[4]) for x in chunking.endpoints_of(code, pathless=True)] == [(["GET", "POST"], "V", 1, 1), (["GET", "POST"], "v", 4, 5)]


def test_search(spark):
    v = spark.createDataFrame([(i, [float(i), 0.0], "x") for i in range(50)] + [(90, None, "x"), (91, [1.0], "x")], "vec_id bigint, embedding array<float>, rank string")
    got = [(r.query_id, r.id, r.distance) for r in retrieval.nearest(v, v.where("vec_id in (0, 20)"), 3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1.0), (0, 2, 4.0), (0, 3, 9.0), (20, 19, 1.0), (20, 21, 1.0), (20, 18, 4.0)]
    assert retrieval.nearest(v.limit(0), v.limit(0), 3).count() == 0
    hops = retrieval.multi_hop(v, v.where("vec_id = 0"), 2, 2).collect()
    assert {(r.id, r.hop) for r in hops} == {(1, 0), (2, 0), (3, 1)}


def test_greedy():
    texts = ["a b c d", "a b c d", "a b c x", "q r", "", "a b c d e"]
    assert retrieval.greedy_unique(texts) == [0, 2, 3, 4]
    assert retrieval.greedy_clusters(["a b", "a b c", "z", "y"], ["p", "q", "r", "r"]) == [0, 0, 2, 2]
    assert retrieval.diverse(["a b", "a b c", "z"], 2) == [0, 2] and retrieval.diverse([], 3) == []


def test_tree_and_manifests(spark, tmp_path):
    for rel, data in {"pkg/__init__.py": b"x", "requirements.txt": b"# c\nflask[async]>=2 ; x\n-e .\nnumpy\n", "package.json": b'{"dependencies": {"a": "^1"}, "devDependencies": {"b": "2"}}', "pyproject.toml": b'[project]\ndependencies = ["p>=1"]\n[tool.poetry.dependencies]\npython = "3"\nq = {version = "2", optional = true}\n', "Dockerfile": b"FROM ubuntu:20.04\nFROM my-redis:6 AS x\n", "docker-compose.yml": b"services:\n  db:\n    image: postgres:15\n  web:\n    build: .\n", "node_modules/x.py": b"", ".hidden/y.py": b"", "latin.py": "é".encode("latin-1")}.items():
        p = tmp_path / rel
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    files_ = tree.with_text(tree.read_tree(spark, str(tmp_path), partitionBytes="10")).withColumn("repo_id", F.lit("r")).cache()
    got = {r.file_path: r.raw_content for r in files_.collect()}
    assert "pkg/__init__.py" in got and got["latin.py"] == "é" and not any("node_modules" in k or ".hidden" in k for k in got)
    deps = {(r.name, r.version, r.dependency_type) for r in manifests.all_dependencies(files_).collect()}
    assert {("flask", ">=2", "application"), ("numpy", "any", "application"), ("a", "^1", "application"), ("b", "2", "development"), ("p", ">=1", "application"), ("q", "2", "optional")} == deps
    assert [(r.name, r.version, r.service_type) for r in manifests.dockerfiles(files_).collect()] == [("my-redis", "6", "cache")]
    assert {(r.name, r.version, r.service_type) for r in manifests.compose(files_).collect()} == {("db", "15", "database"), ("web", "latest", "application")}
    assert tree.decode_text("hé".encode("utf-16")) == "hé" and tree.decode_text(None) is None
    assert tree.archive_id("/a/b/").startswith("archive_b_") and len(tree.archive_id("/a/b/")) == 18
    assert one(spark, "https://github.com/Own er/re.po.git", tree.repo_id_from_url) == "Own-er_re-po" and one(spark, "x", tree.repo_id_from_url) is None


def test_blame(spark):
    sha = "a" * 40
    raw = f"{sha} 1 1 1\nauthor A\nauthor-mail <a@x>\n\tcode\n{sha} 2 2\nauthor B\nauthor-mail <>\n\tmore\n"
    lines = tree.blame_lines(spark.createDataFrame([("r", "f", raw), ("r", "g", None)], "repo_id string, file_path string, porcelain string"))
    assert [(r.email, r.line_no) for r in lines.orderBy("line_no").collect()] == [("a@x", 1), (None, 2)]
    assert tree.blame_counts(lines).count() == 2


def test_stores(spark, tmp_path):
    p = str(tmp_path / "t")
    a = spark.createDataFrame([("r/1", 1), ("s", 2)], "repo_id string, v int")
    stores.write_table(a, p)
    stores.write_table(spark.createDataFrame([("s", 3)], "repo_id string, v int"), p)
    assert {(r.repo_id, r.v) for r in spark.read.parquet(p).collect()} == {("r/1", 1), ("s", 3)}
    assert stores.delete_repository(spark, p, "r/1") and not stores.delete_repository(spark, p, "r/1")
    (tmp_path / "d.json").write_text(json.dumps({"repo_id": "r", "files": [{"file_path": "a", "text_chunks": [{"chunk_id": "c"}]}]}))
    assert stores.read_documents(spark, str(tmp_path / "d.json")).first().files[0].text_chunks[0].chunk_id == "c"
    with pytest.raises(stores.NotFound):
        stores.read_documents(spark, str(tmp_path / "none.json"))
    (tmp_path / "bad.json").write_text('{"repo_id": ')
    with pytest.raises(Exception, match="(?i)malformed"):
        stores.read_documents(spark, str(tmp_path / "bad.json")).collect()
    assert [r.repo_id for r in stores.catalogue(a, a.where("v = 2")).collect()] == ["s"]


def test_stream(spark, tmp_path):
    rows = [("r", 10, "m", 1.0), ("r", 10, "m", 1.0), ("r", 20, "m", 3.0), ("r", 40 * 86_400, "m", 9.0)]
    df = spark.createDataFrame(rows, "repo_id string, s bigint, metric string, value double").selectExpr("repo_id", "timestamp_seconds(s) ts", "metric", "value")
    src = str(tmp_path / "in")
    df.write.parquet(src)
    q = stream.write(stream.windowed(stream.read(spark, src)), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert q.awaitTermination(120)
    got = [(r.n, r.mean_value) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert got == [(2, 2.0)]

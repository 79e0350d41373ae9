from pyspark.sql import functions as F

from quillon.operators import compose, edits

PY = "import a\n\n@d\ndef f():\n    return 1\n\nclass C:\n    pass\n"
RS = "struct P {\n    x: i64,\n}\n\nfn g(a: i64) -> i64 {\n    if a > 1 {\n        return 2;\n    }\n    a\n}\n"


def test_blocks():
    assert edits.find_block(PY, "f", "python") == (3, 5) and edits.find_block(PY, "C", "python") == (7, 8) and edits.find_block(PY, "q", "python") is None
    assert edits.find_block(RS, "g", "rust") == (5, 10) and edits.find_block(RS, "P", "rust") == (1, 3)
    assert edits.find_block("# A\nx\n## B\ny\n# C\n", "A", "markdown") == (1, 4) and edits.find_block("def f(:", "f", "python") is None


def test_apply():
    text, report = edits.apply_ops(PY, [("REPLACE_BLOCK", "f", "def f():\n    return 2"), ("REPLACE_BLOCK", "zz", "x"), ("MOVE", "f", None), ("ADD_FIELD_TO_STRUCT", "C", "y")], "python")
    assert "return 2" in text and "@d" not in text and report == ["ok", "error: zz not found", "error: unknown operation", "error: no struct in this language"]
    assert edits.apply_ops(RS, [("ADD_FIELD_TO_STRUCT", "P", "y: i64,")], "rust")[0].startswith("struct P {\n    x: i64,\n    y: i64,\n}")
    assert edits.apply_ops("", [("CREATE_FILE", None, "z")], "go") == ("z", ["ok"])


def test_plan(spark):
    files = spark.createDataFrame([("a.py", "python", PY)], "file_path string, language string, text string")
    ops = spark.createDataFrame([(2, "REPLACE_BLOCK", "a.py", "C", "class D: pass"), (1, "REPLACE_BLOCK", "a.py", "f", "x = 1"), (1, "CREATE_FILE", "new.py", None, "y"), (1, "BAD", "a.py", None, None)], "seq bigint, operation string, file_path string, target_identifier string, content string")
    got = {r.file_path: r for r in edits.apply_plan(files, ops).collect()}
    assert got["new.py"].new_text == "y" and got["a.py"].n_ok == 2 and got["a.py"].n_failed == 1 and "class D" in got["a.py"].new_text
    bad = {(r.operation, r.file_path): r.problems for r in edits.checked_plan(ops).collect()}
    assert bad["BAD", "a.py"] == ["unknown operation"] and bad["CREATE_FILE", "new.py"] == []


def test_validators():
    assert edits.documented('def f():\n    "d"\n\nclass C: pass\n') == (2, 1) and edits.documented("def (") == (0, 0) and edits.documented(None) == (0, 0)
    assert edits.valid_test("def test_a():\n    pass\n") and not edits.valid_test("def a(): pass") and not edits.valid_test("def test_(")


def test_joins(spark):
    issues = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "number bigint, title string")
    scores = spark.createDataFrame([(1, 5), (3, 5), (9, 7)], "issue_number bigint, score int")
    assert [(r.number, r["rank"]) for r in compose.ranked_issues(scores, issues).orderBy("rank").collect()] == [(1, 1), (3, 2)]
    plan = spark.createDataFrame([("r", "x.py"), ("r", "new.py")], "repo_id string, file_path string")
    files = spark.createDataFrame([("r", "x.py", 1, "old"), ("r", "x.py", 2, "text")], "repo_id string, file_path string, file_id bigint, raw_content string")
    assert {r.file_path: r.raw_content for r in compose.plan_files(plan, files).collect()} == {"x.py": "text", "new.py": ""}


def test_relevant_code():
    py = "import os\nfrom a import b\n\nclass A:\n    def m(self):\n        return 1\n\ndef f():\n    return A()\n\ndef g(): pass\n"
    got = edits.relevant_code(py, ["f", "m"], "x.py")
    assert got.startswith("import os") and "def m(self)" in got and "def f()" in got and "class A" not in got and "def g" not in got
    assert edits.relevant_code(py, ["none"], "x.py") == py and edits.relevant_code("def f(:", ["f"], "x.py") == "def f(:" and edits.relevant_code(None, ["f"], None) == ""
    assert edits.relevant_code("a f\nb\nf c", ["f"], "x.js") == "a f\nf c" and edits.relevant_code("a", ["q"], None) == "a"


def test_compressed_and_docstrings(spark):
    df = spark.createDataFrame([("x.py", "x = 1\n  def f(a):\n    pass\n"), ("y.js", "keep f\ndrop"), (None, None)], "file_path string, raw_content string")
    assert [r.relevant for r in edits.compressed(df, ["f"]).orderBy("file_path").collect()] == ["", "x = 1\n  def f(a):\n    pass\n", "keep f"]
    done = [r[0] for r in df.select(edits.with_docstring(F.col("raw_content"), F.lit("Adds."))).collect()]
    assert done[0] == 'x = 1\n  def f\n      """Adds."""(a):\n    pass\n' and done[1] == "keep f\ndrop" and done[2] is None

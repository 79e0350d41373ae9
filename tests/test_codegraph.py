import json

from quillon.operators import codegraph

PY = '''import os, sys.path
from . import a, b
from x.y import z as w


class A(Base, m.Mixin[int]):
    def one(self):
        def inner():
            return helper(1)
        return self.two(inner())

    async def two(self):
        return super().two()


def run(x):
    print(A().one(), f"{x}")
    (lambda: 1)()
'''
JS = '''import def, { x } from "./mod";
import "side";
const fs = require('fs'), other = require("./o\\"x");
// call(not)
/* nor(this) */
export function go(a) { return fs.readFile(a, () => done(a)); }
export default class Page extends Base { render(x) { if (x) { this.draw(x); } return new Map(); } static make() {} }
const add = (a, b) => a + b, twice = async x => add(x, x), plain = function named() {};
let text = "skip(this)", re = /call(me)/g;
'''


def test_python_facts():
    facts = codegraph.python_facts(PY)
    assert [(k, n) for k, _, n, _ in facts if k == "import"] == [("import", "os"), ("import", "sys.path"), ("import", "."), ("import", "."), ("import", "x.y")]
    assert [(o, n) for k, o, n, _ in facts if k == "base"] == [("A", "Base"), ("A", "m.Mixin[int]")]
    assert [(k, o, n) for k, o, n, _ in facts if k in ("class", "function", "method")] == [("class", None, "A"), ("method", "A", "one"), ("method", "A", "inner"), ("function", None, "run")]
    calls = [(o, n) for k, o, n, _ in facts if k == "call"]
    assert calls == [("A", "helper"), ("A", "self.two"), ("A", "inner"), ("A", "super().two"), ("A", "super"), (None, "print"), (None, "A().one"), (None, "A"), (None, "lambda: 1")]
    assert codegraph.python_facts("def f(:") is None and codegraph.python_facts("") == []


def test_javascript_facts():
    facts = codegraph.javascript_facts(JS)
    of = lambda kind: [n for k, _, n, _ in facts if k == kind]
    assert of("import") == ["./mod", "side", "fs", './o\\"x']
    assert of("function") == ["go", "add", "twice"] and of("class") == ["Page"] and of("export") == ["go"]
    assert of("call") == ["require", "require", "readFile", "done", "draw", "add"]
    assert {n: line for k, _, n, line in facts if k in ("function", "class")} == {"go": 6, "Page": 7, "add": 8, "twice": 8}
    assert codegraph.javascript_facts("") == [] and codegraph.javascript_facts("(" * 5_000 + "f(" * 500)[-1][2] == "f"


def test_graph(spark):
    rows = [(1, "r", "main", "a.py", "def old(): pass"), (2, "r", "main", "a.py", PY), (3, "r", "dev", "a.py", "import q\n"), (4, "r", "main", "b.js", JS), (5, "r", "main", "bad.py", "def f(:"), (6, None, None, "n.py", "x()"), (7, "r", "main", "t.ts", "f()"), (8, "r", "main", None, "f()"), (9, "r", "main", "e.py", None)]
    found = codegraph.facts(spark.createDataFrame([(*r, "clash") for r in rows], "file_id bigint, repo_id string, ref string, file_path string, raw_content string, name string")).cache()
    nodes = {(n["ref"], n.node_id): n for n in codegraph.nodes(found).collect()}
    assert set(nodes) == {("main", "a.py"), ("main", "a.py::A"), ("dev", "a.py"), ("main", "b.js"), (None, "n.py"), ("main", "e.py")}
    assert nodes["main", "a.py"].functions == ["run"] and nodes["main", "a.py"].classes == ["A"] and nodes["main", "a.py::A"].methods == ["one", "inner"] and nodes["main", "b.js"].exports == ["go"]
    e = [(x["ref"], x.source, x.target, x.type) for x in codegraph.edges(found).orderBy("source", "seq").collect()]
    assert ("dev", "a.py", "q", "IMPORTS") in e and (None, "n.py", "x", "CALLS") in e and ("main", "a.py::A", "Base", "INHERITS_FROM") in e and ("main", "a.py", "old", "CALLS") not in e
    counts = {(c.repo_id, c.source): (c.n_imports, c.n_calls, c["rank"]) for c in codegraph.call_counts(codegraph.edges(found).where("ref = 'main'")).collect()}
    assert counts["r", "a.py"] == (4, 4, 3) and counts["r", "b.js"] == (4, 6, 1) and counts["r", "a.py::A"] == (0, 5, 2)
    ends = spark.createDataFrame([(2, "/a", "run"), (2, "/b", "one"), (2, "/c", "gone")], "file_id bigint, path string, handler string")
    got = {x.path: (x.node_id, x.targets) for x in codegraph.handler_edges(ends, found).collect()}
    assert got["/c"] == (None, []) and got["/b"][0] == "a.py::A" and "helper" in got["/b"][1] and "print" in got["/a"][1]
    assert codegraph.nodes(found.limit(0)).count() == 0 and json.dumps([n for n in nodes if n[0]])

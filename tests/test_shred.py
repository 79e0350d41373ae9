import json

from quillon.operators import shred

DOC = {
    "repo_id": "r1",
    "files": [
        None,
        {
            "file_path": "a.py",
            "text_chunks": [{"chunk_id": "c1", "token_count": "7", "start_line": 1}, {"chunk_id": "c1"}],
            "api_endpoints": {"path": "/x", "methods": "GET"},
        },
        {"file_path": "b.py", "text_chunks": {"chunk_id": "c2"}, "api_endpoints": [{"path": "/z", "methods": ["PUT", "GET"]}]},
        {"file_path": "c.py", "text_chunks": {"k1": {"chunk_text": "t"}, "k2": {"chunk_text": "u"}}},
        {"detected_language": "go"},
    ],
    "tech_stack_bom": {
        "dependencies": {"application": [{"name": "d1"}], "peer": None, "testing": {"name": "d2", "version": "1"}},
        "services": [{"name": "s1", "ports": [1], "environment": {"MODE": "x"}}],
    },
}
WANT = {
    ("file", "r1", "a.py"), ("file", "r1", "b.py"), ("file", "r1", "c.py"),
    ("chunk", "a.py", "c1"), ("chunk", "b.py", "c2"), ("chunk", "c.py", "k1"), ("chunk", "c.py", "k2"),
    ("endpoint", "a.py", "/x"), ("endpoint", "b.py", "/z"), ("dependency", "application", "d1"), ("dependency", "testing", "d2"), ("service", "r1", "s1"),
}


def _df(spark, rows):
    return spark.createDataFrame(rows, "record_id bigint, payload string, node string, kind string")


def test_links_of_every_shape(spark):
    keyed = {"repo_id": "r2", "files": {"p/q.go": {"api_endpoints": [{"path": "/y"}], "text_chunks": []}}}
    rows = [
        (1, json.dumps(DOC), "clash", "clash"),
        (2, json.dumps(json.dumps(json.dumps(json.dumps(json.dumps(json.dumps(DOC)))))), None, None),
        (3, json.dumps({"exported_by": "x", "cortex": keyed}), None, None),
        (4, json.dumps(DOC)[:-9], None, None),
        (5, None, None, None),
        (6, "", None, None),
        (7, "[]", None, None),
        (8, "not json", None, None),
    ]
    got = {tuple(r) for r in shred.links(shred.shred(_df(spark, rows))).collect()}
    want = {(i, *w) for i in (1, 2) for w in WANT}
    want |= {(3, "file", "r2", "p/q.go"), (3, "endpoint", "p/q.go", "/y")}
    assert got == want


def test_tables_and_types(spark):
    nodes = shred.shred(_df(spark, [(1, json.dumps(DOC), None, None)]))
    chunks = shred.entity_table(nodes, "chunk").orderBy("node").collect()
    assert [c.child_key for c in chunks] == ["c1", "c1", "c2", "k1", "k2"]
    assert chunks[0].token_count == 7 and chunks[0].start_line == 1 and chunks[3].chunk_text == "t"
    stored = shred.stored(_df(spark, [(1, json.dumps(DOC), None, None)]))
    for n in (nodes, stored):
        end = {r.path: (r.methods, r.parent_key) for r in shred.entity_table(n, "endpoint").collect()}
        assert end == {"/x": (["GET"], "a.py"), "/z": (["PUT", "GET"], "b.py")}


def test_empty_table(spark):
    assert shred.links(shred.shred(_df(spark, []))).count() == 0


def test_nodes_rebuild_the_document():
    nodes = shred.shred_value({"a": [1, {"b": None}], "c": "x"})
    assert [n[2] for n in nodes] == ["$", "a", "[]", "[]", "b", "c"]
    assert nodes[4][1] == 3 and nodes[4][4] == "null"


def test_very_long_and_deep(spark):
    deep = "[" * 900 + "]" * 900
    rows = [(1, json.dumps({"repo_id": "r", "files": [{"file_path": "x" * 200_000}]}), None, None), (2, deep, None, None)]
    got = shred.links(shred.shred(_df(spark, rows))).collect()
    assert len(got) == 1 and len(got[0].child_key) == 200_000

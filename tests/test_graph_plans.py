"""The registered graph queries walk the graph and do not only return their seeds."""

import os
from collections import defaultdict

import pytest

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


@pytest.fixture(scope="module")
def edges(spark):
    from quillon.operators import graph
    from quillon.sources.tables import table

    rows = graph.import_edges(table(spark, D, "source_files")).collect()
    out = defaultdict(dict)
    for r in sorted(rows, key=lambda r: (r.seq, r.target)):
        out[r.repo_id, r.source].setdefault(r.target, None)
    return {k: list(v) for k, v in out.items()}


def test_traces_are_all_walks(spark, edges):
    want = []

    def walk(repo, start, at, path, depth):
        for to in edges.get((repo, at), []):
            if depth <= 10:
                want.append((repo, start, at, to, depth, False))
                if to not in path:
                    walk(repo, start, to, [*path, to], depth + 1)
                elif depth < 10:
                    want.append((repo, start, at, to, depth, True))

    for repo, start in edges:
        walk(repo, start, start, [start], 1)
    got = [(r.repo_id, r.start, r.source, r.target, r.depth, r.is_recursive) for r in entry.queries()["call_traces"](spark, D).collect()]
    assert sorted(got) == sorted(want) and len(got) > len(edges)
    assert len(got) == sum(r.n_steps for r in entry.queries()["trace_stats"](spark, D).collect())


def test_traces_go_to_ten(spark, monkeypatch):
    from quillon.plans import graphs

    chain = spark.createDataFrame([("r", 0, f"n{i:02}", f"n{i + 1:02}", "IMPORTS") for i in range(12)], "repo_id string, seq bigint, source string, target string, type string")
    monkeypatch.setattr(graphs, "_edges", lambda *_: chain)
    got = graphs.call_traces(spark, D).collect()
    assert len(got) == sum(min(10, 12 - i) for i in range(12)) and max(r.depth for r in got) == 10


def test_order_has_edges(spark, edges):
    levels = {(r.repo_id, r.node): r.level for r in entry.queries()["learning_order"](spark, D).collect()}
    pairs = [(levels[repo, s], levels[repo, t]) for (repo, s), ts in edges.items() for t in ts if (repo, s) in levels and (repo, t) in levels and s != t]
    assert max(levels.values()) > 0 and len(pairs) > 100 and all(a < b for a, b in pairs)
    assert entry.queries()["guided_steps"](spark, D).count() == len(levels)


@pytest.mark.parametrize("name", ["reachable_linked", "blast_radius_linked", "one_hop_linked"])
def test_linked_seeds(spark, edges, name):
    rows = entry.queries()[name](spark, D)
    if "seed" in rows.columns:
        assert {(r.repo_id, r.seed) for r in rows.select("repo_id", "seed").distinct().collect()} == set(edges)
    assert rows.count() > len(edges) or name == "blast_radius_linked"

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import packing as P


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80))
def test_best_fit_is_a_partition(sizes):
    bins = P.best_fit(sizes, 50)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 50 for b in bins)
    assert len(bins) <= 2 * -(-sum(sizes) // 50) + 1


def _classes(spark, rows):
    return spark.createDataFrame(rows, "class_name string, capacity_tokens int")


def test_pack(spark, monkeypatch):
    monkeypatch.setattr(P, "GROUP_ITEMS", 300)  # several groups and levels
    r = random.Random(2)
    sizes = [(i, r.choice([3, 17, 60, 90, 150, 410, 999, 2500]) + r.randint(0, 9), "x") for i in range(2_000)]
    rows = [*sizes, (5_000, 0, None), (5_001, None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint, capacity string")
    got = P.pack(df, _classes(spark, [("small", 512), ("big", 2048), ("none", None)])).collect()
    for name, capacity in (("small", 512), ("big", 2048)):
        rows = [g for g in got if g.class_name == name]
        used, parts = {}, {}
        for g in rows:
            used[g.container] = used.get(g.container, 0) + g["size"]
            parts.setdefault(g["item"], []).append((g.segment, g["size"]))
        assert sorted(used) == list(range(len(used))) and max(used.values()) <= capacity
        for i, n, _ in sizes:
            assert sum(s for _, s in parts[i]) == n
            assert len(parts[i]) == -(-n // capacity) and sorted(x for x, _ in parts[i]) == list(range(len(parts[i])))
        assert not {5_000, 5_001} & set(parts)
        assert sum(used.values()) / (len(used) * capacity) > 0.97


def test_hard_cases(spark):
    same = spark.createDataFrame([(i % 7, 300) for i in range(50)], "doc_id bigint, n_tokens bigint")
    got = P.pack(same, _classes(spark, [("c", 512)]))
    assert got.count() == 50 and got.select("container").distinct().count() == 50
    assert P.pack(same.limit(0), _classes(spark, [("c", 512)])).count() == 0

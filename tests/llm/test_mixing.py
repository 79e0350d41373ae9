import random

import pytest

from quillon.llm import mixing as M


def _rows(n=900, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        source = r.choices(["big_one", "mid", "tiny"], [70, 25, 5])[0]
        out.append((i, r.choice([source, source.upper(), source.replace("_", "-"), source + " "]), r.randint(1, 40)))
    return out


def test_shares_and_repeats(spark):
    rows = _rows()
    sized = spark.createDataFrame([*rows, (10_000, None, 5), (10_001, "mid", 0)], "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("m", "big_one", 0.5, 2), ("m", "mid", 0.3, 2), ("m", "tiny", 0.2, 3), ("m", "gone", 0.1, 4), ("n", "tiny", None, 1), ("n", "mid", 1.0, 1), ("n", "mid", 1.0, 1)], "mix_name string, source string, target_share double, max_repeats int")
    got = M.mix(sized, targets).collect()
    assert len({(g.mix_name, g.doc_id, g["copy"]) for g in got}) == len(got)
    size = {i: n for i, _, n in rows}
    name = {i: s.strip().lower().replace("-", "_") for i, s, _ in rows}
    have = {s: sum(size[i] for i in size if name[i] == s) for s in ("big_one", "mid", "tiny")}
    total = min(have["big_one"] * 2 / 0.5, have["mid"] * 2 / 0.3, have["tiny"] * 3 / 0.2)
    for source, share, repeats in (("big_one", 0.5, 2), ("mid", 0.3, 2), ("tiny", 0.2, 3)):
        mine = [g for g in got if g.mix_name == "m" and g.source == source]
        assert abs(sum(g.n_tokens for g in mine) - total * share) <= 40
        copies = {}
        for g in mine:
            assert g.n_tokens == size[g.doc_id] and name[g.doc_id] == source
            copies[g.doc_id] = max(copies.get(g.doc_id, 0), g["copy"])
        assert max(copies.values()) <= repeats
        least = int(total * share) // have[source]
        assert all(copies.get(i, 0) >= least for i in size if name[i] == source)
    report = {(x.mix_name, x.source): x for x in M.report(M.mix(sized, targets), targets).collect()}
    assert report["m", "gone"].tokens == 0 and abs(report["m", "mid"].actual_share - 0.3) < 0.02
    assert report["n", "mid"].actual_share == 1.0


def test_a_source_named_unknown_is_a_source(spark):
    sized = spark.createDataFrame([(1, "unknown", 5), (2, None, 7), (3, "  ", 7)], "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("m", "Unknown", 1.0, 1)], "mix_name string, source string, target_share double, max_repeats int")
    assert [r.doc_id for r in M.mix(sized, targets).collect()] == [1]


def test_selection_follows_the_sorted_keys(spark):
    sized = spark.createDataFrame(_rows(400, 2), "doc_id bigint, source string, n_tokens bigint")
    docs = sorted((r.key, r.doc_id, r.n_tokens) for r in M.keyed(sized).where("source = 'big_one'").collect())
    targets = spark.createDataFrame([("m", "big_one", 1.0, 1)], "mix_name string, source string, target_share double, max_repeats int")
    want, budget = 0, 700
    chosen = set()
    for _, i, n in docs:
        if want + n > budget and want + n - budget > budget - want:
            break
        chosen.add(i)
        want += n
        if want >= budget:
            break
    got = {r.doc_id for r in M.mix(sized, targets, total_tokens=budget).collect()}
    assert got == chosen


def test_quality_raises_the_chance(spark):
    rows = [(i, "s", 10) for i in range(4_000)]
    sized = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")
    weights = spark.createDataFrame([(i, 5 if i % 2 else 1) for i in range(4_000)] + [(1, None)], "doc_id bigint, quality int")
    targets = spark.createDataFrame([("m", "s", 1.0, 1)], "mix_name string, source string, target_share double, max_repeats int")
    got = [r.doc_id for r in M.mix(sized, targets, weights, total_tokens=8_000).collect()]
    odd = sum(i % 2 for i in got) / len(got)
    assert len(got) == 800 and odd == pytest.approx(5 / 6, abs=0.06)
    assert M.mix(sized.limit(0), targets, weights).count() == 0

import random

import numpy as np
import pytest

from quillon.llm import toxicity as T

NOUN = "river stone cloud meadow harbor lantern copper winter garden falcon".split()
MILD = ["The {} takes {} ms.", "Please add a test that covers the {} and the {}.", "Kill the child process when the {} stays open.", "I could not open the {} on this machine.", "Each {} holds at most {} items.", "The `sex` column of the {} may be null."]
BAD = ["You are a {} idiot and your {} is garbage.", "Shut up, you {} moron, nobody wants your {}.", "What a {} loser, I hope your {} burns.", "Forget the {}, send me nudes {}."]


def _doc(r, toxic):
    s = [r.choice(MILD).format(r.choice(NOUN), r.randint(1, 99)) for _ in range(r.randint(3, 9))]
    if toxic:
        s.insert(r.randrange(len(s)), r.choice(BAD).format(r.choice(["stupid", "pathetic", "useless"]), r.choice(NOUN)))
    return " ".join(s)


@pytest.mark.parametrize(("a", "b"), [("idiоtа", "idiot" + "a"), ("asshole", "@$$h0l3"), ("stupid", "stupiddd"), ("horny", "h0rny"), ("moron", "mоrоn"), ("x", "X")])
def test_norm(a, b):
    assert T._norm(a) == T._norm(b)


def test_spelling_tricks_are_joined():
    assert T._units("you p.o.r.n fan")[0][1] == ["porn"] and T._units("a b​ad one") == T._units("a bad one")
    assert T._norm("a*****e") == "~ae" and T._norm("@river") == "@" and T._norm("123") == "0"


def test_held_out_accuracy():
    r = random.Random(3)
    rows = [(_doc(r, i % 6 == 0), int(i % 6 == 0)) for i in range(600)]
    noisy = [(t, 1 - y if r.random() < 0.03 else y) for t, y in rows[:400]]
    keys, values, bias = T.train([(*map(np.array, h), y) for h, (_, y) in zip(T.hash_rows([t for t, _ in noisy]), noisy)])
    assert 0 < len(keys) < 20_000
    dense = np.zeros(T.DIM)
    dense[keys] = values
    scores = T.score_texts([t for t, _ in rows[400:]] + [None, ""], dense, bias)
    got = [(s >= T.THRESHOLD, y) for s, (_, y) in zip(scores, rows[400:])]
    assert sum(p == bool(y) for p, y in got) >= 0.97 * len(got)
    assert scores[-1] == scores[-2] == 0
    # alone, in another order or in a batch, a text has the same score; a bad sentence in a very long text or a sentence without an end is found
    assert all(abs(T.score_texts([t], dense, bias)[0] - s) < 1e-9 for (t, _), s in zip(rows[400:450], scores))
    bad = next(t for (t, y), s in zip(rows[400:], scores) if y and s > 0.9)
    filler = "the river holds the stone and " * 3000
    assert T.score_texts([filler + ". " + bad], dense, bias)[0] > 0.9 and T.score_texts([filler + bad.split(". ")[0]], dense, bias)[0] >= 0


def test_windows_are_the_same_at_every_size():
    for n in (1, 119, 120, 121, 180, 181, 500):
        units = T._units(" ".join(f"w{i % 7}x" for i in range(n)))
        covered = units[0][0] if units else []
        assert len(covered) <= T.WINDOW and sum(len(c) for c, _ in units) >= n


def test_tables(spark):
    r = random.Random(4)
    docs = [(i, _doc(r, i % 5 == 0), "Hub-Issues " if i % 2 else "hub_issues", 1.0) for i in range(300)] + [(1000, None, None, 1.0), (1001, "", None, 1.0), (1002, "fine " * 60_000, "x", 1.0)]
    labels = [(i, 3, int(i % 5 == 0)) for i in range(0, 300)] + [(1000, 1, None), (None, 1, 1), (5, 3, 1)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string, score double")
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    scored = T.score(d, T.fit(d, lab)).cache()
    flagged = {x.doc_id for x in scored.where(f"score >= {T.THRESHOLD}").collect()}
    want = {i for i in range(0, 300, 5)}
    assert len(flagged & want) >= 0.95 * len(want) and len(flagged - want) <= 3
    rates = {x.source: x for x in T.rates(scored).collect()}
    assert set(rates) == {"hub_issues", "unknown", "x"} and rates["hub_issues"].n_docs == 300
    empty = T.fit(d.limit(0), lab.limit(0))
    assert T.score(d.limit(0), empty).count() == 0 and T.score(d, empty).where("score > 0.5").count() == 0

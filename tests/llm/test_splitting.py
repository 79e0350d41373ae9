import random

import pytest

from quillon.llm import splitting as S


def _check(text, **kw):
    parts = S.split(text, **kw)
    n_tok, n_chr = kw.get("max_tokens", S.MAX_TOKENS), kw.get("max_chars", S.MAX_CHARS)
    assert "".join(text[core:end] for _, core, end in parts) == text
    for k, (start, core, end) in enumerate(parts):
        body = text[start:end]
        assert len(body) <= n_chr and len(S._TOKEN.findall(body)) <= n_tok
        assert start <= core and (k == 0) == (start == core == 0) or k and start <= core
    return parts


def test_round_trip_and_limits():
    r = random.Random(1)
    for n in (1, 50, 801, 5_000):
        words = ["".join(r.choice("abcde.") for _ in range(r.randint(1, 12))) for _ in range(n)]
        text = "".join(w + r.choice([" ", " ", "\n", "\n\n", " "]) for w in words)
        parts = _check(text)
        assert (len(parts) > 1) == (len(text) > 8000 or n > 800)
        _check(text, max_tokens=60, max_chars=700, overlap_tokens=7, overlap_chars=90)


def test_overlap_is_the_end_of_the_piece_before():
    text = " ".join(f"w{i}" for i in range(3_000))
    parts = _check(text)
    for start, core, _ in parts[1:]:
        assert len(S._TOKEN.findall(text[start:core])) == S.OVERLAP_TOKENS


def test_cuts_at_definitions():
    text = "\n\n".join(f"def f{i}(a):\n" + "\n".join(f"    a = a + {j}" for j in range(20)) for i in range(30))
    parts = _check(text)
    assert all(text[core:].startswith("def ") for _, core, _ in parts)


@pytest.mark.parametrize("text", ["x" * 20_001, "字" * 9_000, "\n" * 8_001, " " * 9_000])
def test_no_boundaries(text):
    assert len(_check(text)) > 1


def test_table(spark):
    body = "\n".join(f"line {i} of text" for i in range(400))
    rows = [("a", body, 11, "c"), ("a", body, 11, "c"), ("b", None, 1, "c"), ("c", "", None, "c"), ("d", "short", 3, "c"), ("e", "x " * 801, None, "c"), ("f", "x " * 800, 1, "c"), ("g", "y" * 8000, 1, "c")]
    df = spark.createDataFrame(rows, "chunk_id string, chunk_text string, start_line int, kind string")
    got = S.pieces(df, "chunk", "chunk_id", "chunk_text", "start_line").distinct().collect()
    assert {r["item"] for r in got} == {"a", "e"}
    lines = body.split("\n")
    for r in got:
        assert r.token_count == len(r.text.split()) and r.n_chars == len(r.text)
        if r["item"] == "a":
            assert r.text.split("\n")[0] in lines[r.start_line - 11]
            assert r.end_line == r.start_line + r.text.rstrip("\n").count("\n")
    assert S.pieces(df.limit(0), "chunk", "chunk_id", "chunk_text").count() == 0

"""Splitting oversized items at natural boundaries (problem 7).

Method: recursive bisection. A text over the limit is cut at the strongest boundary near its midpoint; halves that still exceed the
limit minus the overlap are cut again; then every piece but the first gets the end of the one before it as overlap.
Boundaries, strongest first: a blank line before a definition, a blank line, a line end before a definition, a line end, a sentence end, white space;
a text without any is cut between code points.

Defined results: null and empty texts, and texts within both limits, are not cut and give no piece. Tokens are runs without Unicode white space, counted
in the piece itself. The overlap is the last ``overlap_tokens`` tokens of the piece before, or its last ``overlap_chars`` code points if those are fewer. Lines end at
``\\n``; a null start line counts as 1. Repeated rows give the same pieces once. Extra columns are ignored.

Scale: sizes are found in the JVM; only oversized texts reach Python, whole and one by one. The one shuffle is the distinct over the pieces of repeated rows.
"""

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.tokens import PY_SPACE, count_words

MAX_TOKENS, MAX_CHARS = 800, 8_000
OVERLAP_TOKENS, OVERLAP_CHARS = 40, 400

_TOKEN = re.compile(f"[^{PY_SPACE}]+")
_DEFINITION = r"[ \t]*(?:(?:export|public|private|protected|static|async|pub|abstract|final|default)\s+)*(?:def|class|func|function|fn|module|struct|impl|interface|enum|trait|type|namespace|package|@\w|#{1,6} )"
_BOUNDARIES = [
    (6, re.compile(rf"\n[ \t\r]*\n(?={_DEFINITION})")),
    (5, re.compile(r"\n[ \t\r]*\n(?![ \t\r]*\n)")),
    (4, re.compile(rf"\n(?={_DEFINITION})")),
    (3, re.compile(r"\n")),
    (2, re.compile(r"[.!?;。！？][\"')\]]?[ \t]+|[。！？]")),
    (1, re.compile(f"[{PY_SPACE}]+")),
]


class _Text:
    """A text with its token places and its boundaries, found once."""

    def __init__(self, text: str) -> None:
        self.text = text
        spans = [m.span() for m in _TOKEN.finditer(text)]
        self.starts, self.ends = [s for s, _ in spans], [e for _, e in spans]
        self.cuts = []
        for strength, pattern in _BOUNDARIES:
            places = [m.end() for m in pattern.finditer(text)]
            self.cuts.append((strength, places))

    def tokens(self, a: int, b: int) -> int:
        """Tokens of text[a:b], parts of tokens included."""
        return bisect_left(self.starts, b) - bisect_left(self.ends, a + 1)

    def cut(self, a: int, b: int) -> int:
        """The strongest boundary in the middle half of text[a:b], nearest to the midpoint in tokens or code points."""
        i, j = bisect_left(self.ends, a + 1), bisect_left(self.starts, b)
        mid = self.starts[(i + j) // 2] if j - i > 1 else (a + b) // 2
        if not a < mid < b:
            mid = (a + b) // 2
        low, high = a + max(1, (mid - a) // 2), mid + max(1, (b - mid) // 2)
        for _, places in self.cuts:
            k = bisect_left(places, mid)
            near = [p for p in places[max(0, k - 1) : k + 1] if low <= p <= high and a < p < b]
            if near:
                return min(near, key=lambda p: (abs(p - mid), p))
        return mid


def bisect(text: str, max_tokens: int, max_chars: int) -> tuple[_Text, list[tuple[int, int]]]:
    """Core spans, each within the limits, that follow each other and cover the text."""
    t = _Text(text)
    out, todo = [], [(0, len(text))]
    while todo:
        a, b = todo.pop()
        if b - a <= max_chars and t.tokens(a, b) <= max_tokens:
            out.append((a, b))
        else:
            c = t.cut(a, b)
            todo += [(c, b), (a, c)]
    return t, out


def split(text: str, max_tokens: int = MAX_TOKENS, max_chars: int = MAX_CHARS, overlap_tokens: int = OVERLAP_TOKENS, overlap_chars: int = OVERLAP_CHARS) -> list[tuple[int, int, int]]:
    """(start with overlap, core start, end) of every piece; one piece if the text is within the limits."""
    t = _Text(text) if len(text) <= max_chars else None
    if t is not None and t.tokens(0, len(text)) <= max_tokens:
        return [(0, 0, len(text))]
    t, cores = bisect(text, max_tokens - overlap_tokens, max_chars - overlap_chars)
    out = []
    for k, (a, b) in enumerate(cores):
        start = a
        if k and (overlap_tokens or overlap_chars):
            before = cores[k - 1][0]
            last = bisect_left(t.starts, a)
            start = max(before, a - overlap_chars)
            if last:
                start = max(start, t.starts[max(0, last - overlap_tokens)])
                # a token that is only reached in part is left out, unless nothing else would be left
                n = bisect_left(t.starts, start)
                if n < last and start > before:
                    start = t.starts[n]
        out.append((start, a, b))
    return out


def oversized(items: DataFrame, text_col: str, max_tokens: int = MAX_TOKENS, max_chars: int = MAX_CHARS) -> DataFrame:
    """Rows over either limit. Fewer than 2 x tokens - 1 code points cannot be too many tokens."""
    text = F.col(text_col)
    return items.where((F.length(text) > max_chars) | ((F.length(text) > 2 * max_tokens) & (count_words(text) > max_tokens)))


_OUT = "kind string, item string, piece int, n_pieces int, start_line int, end_line int, token_count int, n_chars int, overlap_chars int, text string"


def pieces(items: DataFrame, kind: str, id_col: str, text_col: str, line_col: str | None = None, max_tokens: int = MAX_TOKENS, max_chars: int = MAX_CHARS, overlap_tokens: int = OVERLAP_TOKENS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """Pieces of all oversized items: kind, item, piece (from 0), lines, counts, the overlap's length and the text."""
    line = F.coalesce(F.col(line_col).cast("int"), F.lit(1)) if line_col else F.lit(1)
    slim = oversized(items, text_col, max_tokens, max_chars).select(F.col(id_col).cast("string").alias("item"), line.alias("line"), F.col(text_col).alias("text"))
    names = [x.split()[0] for x in _OUT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, first, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                parts = split(text, max_tokens, max_chars, overlap_tokens, overlap_chars)
                rows, line_no, at = [], first, 0
                for k, (start, core, end) in enumerate(parts):
                    line_no += text.count("\n", at, start) if start >= at else -text.count("\n", start, at)
                    at = start
                    body = text[start:end]
                    rows.append((kind, item, k, len(parts), line_no, line_no + body.rstrip("\n").count("\n"), len(_TOKEN.findall(body)), len(body), core - start, body))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.string(), pa.string(), *[pa.int32()] * 7, pa.string()])], names)

    return slim.mapInArrow(run, _OUT)

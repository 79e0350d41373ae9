"""Abusive, hateful or sexual content (problem 10).

Method: FTRL-proximal logistic regression over hashed word n-grams and skip-grams of sentences. Per-coordinate rates and L1 leave a few
thousand non-zero weights, which are sent to the workers. A document's score is that of its worst unit; units are windows of WINDOW words within sentences, STEP words
apart, so almost every sentence is one. Labels are per document, so training alternates: the worst-scoring unit of every document labelled 1 is its positive example, all units of documents labelled 0
are negative. Spelling tricks (spaced or dotted letters, look-alike letters and digits, stretched letters, masked letters) are undone before hashing.

Defined results: null, empty and placeholder texts score 0. Documents without a label are scored like all others; null labels are
ignored and of several labels of a document the larger counts. Whole texts are scored, of any length. Repeated rows are scored
alike; extra columns are ignored. A null source gives the source ``unknown``.

Scale: scoring is a map without a shuffle, a batch at a time: words become integers once, n-grams are integer arithmetic on arrays. Training rows are chosen by hash from the
labels alone (at most TRAIN_DOCS, of at most TRAIN_CHARS characters each: documented bounds); they are hashed on the workers, and the driver reads slots only. Rates per source combine map-side.
"""

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 18
DIM = 1 << BITS
TRAIN_DOCS, TRAIN_CHARS = 8_000, 20_000
WINDOW, STEP = 120, 60
THRESHOLD = 0.5
LIFT = float(np.log(5.0))  # least lift of a word that makes a sentence a positive example by itself
LONELY = 0.3  # weight of a positive example that shares no telling word with another document, against one that does
ROUNDS, FOLDS = 2, 3

_LOOKALIKE = str.maketrans("аеорсухіјѕԁԛԝһӏвкмнт", "aeopcyxijsdqwhlbkmht")
_LEET = str.maketrans("013457@$!|€", "oieastasiie")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_](?P<s>[ .*_-])(?=[^\W\d_](?![^\W_])))(?:[^\W\d_](?P=s)(?=[^\W\d_](?![^\W_])))+[^\W\d_](?![^\W_])")
#: Every text that _SPACED changes matches this, which is cheaper.
_MAYBE_SPACED = re.compile(r"(?<![^\W_])[^\W\d_]([ .*_-])[^\W\d_]\1[^\W\d_](?![^\W_])")
_SPLIT = re.compile(r"(?<=[.!?])\s+|\n+")
_WORD = re.compile(r"\u00a4?@?[^\W_](?:[\w'’@$!|€*]*[\w@$*])?|[@$€][\w@$!|€*]{2,}|[.!?`:]")
_STRETCH = re.compile(r"([^\W\d_])\1{2,}")


_HIDDEN = re.compile("[\u200b-\u200f\u2060\ufeff\u00ad]")
_JOINED = "\u00a4"  # marks a word put together from single letters


def _join(m: re.Match) -> str:
    return _JOINED + m[0].replace(m["s"], "")


@lru_cache(maxsize=200_000)
def _norm(token: str) -> str:
    """One token without spelling tricks; digits become 0, mentions @."""
    if len(token) == 1:
        return token.lower()
    low = token.lower()
    if low[0] == "@" and low[1:].isalpha():
        return "@"
    if not low.isascii():
        swapped = low.translate(_LOOKALIKE)
        if swapped != low and re.search(r"[a-z]", low):  # mixed scripts within a word
            low = swapped
    if low.isdigit():
        return "0"
    if "*" in low.strip("*") and re.fullmatch(r"[^\W\d_]+\*{2,}[^\W\d_]*", low):
        return f"~{low[0]}{low[-1] if low[-1] != '*' else ''}"
    if re.search(r"[\d@$!|€]", low.rstrip("!|")) and re.search(r"[a-zß-ÿ]", low) or re.search(r"[@$][@$]", low):
        if re.fullmatch(r"[@$]?[a-zß-ÿ]+[0-9@$!|€]+[a-z0-9@$!|€ß-ÿ]*|[@$][@$a-zß-ÿ0-9!|€]+", low) and "_" not in low:
            low = low.translate(_LEET)
    low = _STRETCH.sub(r"\1", low.replace("’", "'"))
    return re.sub(r"\d+", "0", low).strip("'*!")


_MASKED, _UNSURE = 1 << 33, 1 << 34  # marks of a word's code: letters masked; put together from single letters
_START, _END, _ANY_MASKED = (zlib.crc32(x) | 1 << 32 for x in (b"^", b"$", b"~masked"))


class _Codes(dict):
    """Token -> its word's integer with its marks, 0 for what normalises to nothing; filled as tokens are met."""

    def __missing__(self, token: str) -> int:
        word, marks = _norm(token), 1 << 32
        if word and word[0] == _JOINED:
            word, marks = word[1:] or "_", marks | _UNSURE
        elif word and word[0] == "~":
            marks |= _MASKED
        code = zlib.crc32(word.encode("utf-8", "replace")) | marks if word else 0
        if len(self) > 300_000:
            self.clear()
        self[token] = code
        return code


_code = _Codes().__getitem__


def _units(text: str) -> list[tuple[list[int], list[str]]]:
    """(codes, words put together from single letters) of every unit."""
    if not text.isascii():
        text = _HIDDEN.sub("", text.replace(_JOINED, " "))
    if _MAYBE_SPACED.search(text):
        text = _SPACED.sub(_join, text)
    out = []
    for s in _SPLIT.split(text):
        s = s.strip(" \t>*-#.")
        if len(s) < 3:
            continue
        tokens = _WORD.findall(s)
        codes = list(filter(None, map(_code, tokens)))
        unsure = [_norm(t)[1:] for t in tokens if t[0] == _JOINED] if _JOINED in s else []
        if len(codes) <= WINDOW:
            out.append((codes, unsure))
        else:
            out += [(codes[i : i + WINDOW], unsure) for i in range(0, len(codes) - WINDOW + STEP, STEP)]
    return out


_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _slot(codes: np.ndarray) -> np.ndarray:
    return (codes * _ODD[0] >> np.uint64(64 - BITS)).astype(np.int64)


class Hashed:
    """Slots of many units: pairs (unit, slot) of all n-grams and of single words, and the document of every unit."""

    def __init__(self, texts: list[str | None]) -> None:
        flat, unit_of, extra, self.doc = [], [], [], []
        for d, text in enumerate(texts):
            for codes, unsure in _units(text) if text else ():
                u = len(self.doc)
                self.doc.append(d)
                flat += [_START, *codes, _END]
                unit_of.append(len(codes) + 2)
                for w in unsure:  # its ends and inner words are uncertain
                    extra += [(u, zlib.crc32(x.encode("utf-8", "replace")) | 1 << 32) for x in {w[i:j] for i in range(len(w)) for j in range(i + 3, min(len(w), i + 12) + 1)}]
        code = np.array(flat, dtype=np.uint64)
        unit = np.repeat(np.arange(len(self.doc)), unit_of)
        masked, plain = (code & np.uint64(_MASKED)) > 0, code & np.uint64((1 << 33) - 1)
        self.word_unit, self.word_slot = unit, _slot(plain)
        units, slots = [unit], [self.word_slot]
        mixed = [plain * k for k in _ODD[1:]]
        for first, rest in ((0, (1,)), (0, (1, 2)), (0, (2,)), (0, (3,))):  # bigrams, trigrams, skip-grams over one and two words
            n = len(code) - rest[-1]
            if n <= 0:
                continue
            whole = unit[:n] == unit[rest[-1] :]
            key = mixed[0][:n]
            for r in rest:
                key = key ^ (mixed[r][r : r + n] + np.uint64(r * len(rest)))
            units.append(unit[:n][whole])
            slots.append(_slot(key[whole]))
        if masked.any():
            units.append(np.unique(unit[masked]))
            slots.append(np.full(len(units[-1]), int(_slot(np.array([_ANY_MASKED], dtype=np.uint64))[0])))
        if extra:
            units.append(np.array([u for u, _ in extra]))
            slots.append(_slot(np.array([c for _, c in extra], dtype=np.uint64)))
        self.unit, self.slot = np.concatenate(units), np.concatenate(slots)

    def logits(self, dense: np.ndarray) -> np.ndarray:
        """Sum of the weights of every unit's distinct slots."""
        told = dense[self.slot] != 0
        pair = np.unique(self.unit[told] * DIM + self.slot[told])
        return np.bincount(pair // DIM, weights=dense[pair % DIM], minlength=len(self.doc))


class Ftrl:
    """Per-coordinate FTRL-proximal for logistic loss on sets of slots, in small batches."""

    def __init__(self, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.6, l2: float = 0.5) -> None:
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n, self.b = np.zeros(DIM), np.zeros(DIM), [0.0, 0.0]

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def bias(self) -> float:
        z, n = self.b
        return -z / ((self.beta + np.sqrt(n)) / self.alpha)

    def learn(self, flat: np.ndarray, lens: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """One step for a batch of examples, whose slots follow each other in ``flat``."""
        w = self.weights(flat)
        example = np.repeat(np.arange(len(lens)), lens)
        g = (_sigmoid(np.bincount(example, weights=w, minlength=len(lens)) + self.bias()) - y) * weight
        told = np.abs(g) >= 1e-3
        if not told.any():
            return
        keep = told[example]
        at, back = np.unique(flat[keep], return_inverse=True)
        each = g[example[keep]]
        total, square = np.bincount(back, weights=each), np.bincount(back, weights=each * each)
        n = self.n[at]
        self.z[at] += total - (np.sqrt(n + square) - np.sqrt(n)) / self.alpha * self.weights(at)
        self.n[at] += square
        bw, bn, bt, bs = self.bias(), self.b[1], g[told].sum(), (g[told] ** 2).sum()
        self.b[0] += bt - (np.sqrt(bn + bs) - np.sqrt(bn)) / self.alpha * bw
        self.b[1] += bs


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


def _gather(flat: np.ndarray, start: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` that begin at ``start``, one after the other."""
    ends = np.cumsum(lens)
    return flat[np.repeat(start - np.concatenate(([0], ends[:-1])), lens) + np.arange(ends[-1] if len(ends) else 0)]


BATCH = 64


def train(hashed: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray, float]:
    """(slots, weights, bias) from one row a document: slots of its units, their numbers, slots of their single words, their numbers, and the label."""
    hashed = [h for h in hashed if len(h[1])]
    if not hashed:
        return np.zeros(0, dtype=np.int64), np.zeros(0), -30.0
    labels = np.array([h[4] for h in hashed])
    flat, lens = np.concatenate([h[0] for h in hashed]).astype(np.int64), np.concatenate([h[1] for h in hashed]).astype(np.int64)
    words, n_words = np.concatenate([h[2] for h in hashed]).astype(np.int64), np.concatenate([h[3] for h in hashed]).astype(np.int64)
    doc = np.repeat(np.arange(len(hashed)), [len(h[1]) for h in hashed])
    first = np.concatenate(([0], np.cumsum([len(h[1]) for h in hashed])))
    start = np.concatenate(([0], np.cumsum(lens)[:-1]))
    rng = np.random.default_rng(5)
    positives = max(1, int(labels.sum()))
    weight = min(12.0, max(1.0, (len(labels) - positives) / positives / 2))
    # How much more often a word stands in documents labelled 1; the most telling word speaks for its unit. Without other documents that share it, the unit counts less: the label may be a mistake.
    unit_of_word = np.repeat(np.arange(len(lens)), n_words)
    once = np.unique(doc[unit_of_word] * DIM + words)
    seen = [np.bincount(once[labels[once // DIM] == y] % DIM, minlength=DIM) for y in (0, 1)]
    telling, shared = np.full(len(lens), -9.0), np.full(len(lens), -9.0)
    for to, count in ((telling, seen[1]), (shared, np.maximum(seen[1] - 1, 0))):
        lift = np.log(((count + 0.1) / (positives + 1)) / ((seen[0] + 0.5) / (len(labels) - positives + 1)))
        np.maximum.at(to, unit_of_word, lift[words])

    def best(scores: np.ndarray, d: int) -> int:
        return first[d] + int(np.argmax(scores[first[d] : first[d + 1]]))

    marked = np.flatnonzero(labels == 1)
    worst = np.full(len(labels), -1)
    for d in marked:
        u = best(telling, d)
        worst[d] = u if telling[u] > LIFT else -1

    def fit_on(keep: np.ndarray) -> tuple[np.ndarray, float]:
        chosen = worst[keep & (worst >= 0)]
        examples = np.concatenate((np.flatnonzero((labels[doc] == 0) & keep[doc]), chosen))
        y = np.concatenate((np.zeros(len(examples) - len(chosen)), np.ones(len(chosen))))
        model = Ftrl()
        for _ in range(2):
            order = rng.permutation(len(examples))
            for i in range(0, len(order), BATCH):
                k = order[i : i + BATCH]
                at = examples[k]
                model.learn(_gather(flat, start[at], lens[at]), lens[at], y[k], np.where(y[k] > 0, np.where(shared[at] > LIFT, weight, LONELY * weight), 1.0))
        at = np.flatnonzero(model.n)
        dense = np.zeros(DIM)
        dense[at] = model.weights(at)
        return dense, model.bias()

    # A positive document's example is chosen by a model that has not seen it; where none of its units looks
    # abusive to that model or has a telling word, the label is taken for a mistake.
    fold = rng.integers(0, FOLDS, len(labels))
    unit_of = np.repeat(np.arange(len(lens)), lens)
    for _ in range(ROUNDS - 1):
        chosen = worst.copy()
        for f in range(FOLDS):
            dense, bias = fit_on(fold != f)
            logits = np.bincount(unit_of, weights=dense[flat], minlength=len(lens)) + bias
            for d in marked[fold[marked] == f]:
                u = best(logits + telling, d)
                chosen[d] = u if logits[u] > 0 or telling[u] > LIFT else -1
        worst = chosen
    dense, bias = fit_on(np.ones(len(labels), dtype=bool))
    keys = np.flatnonzero(dense)
    return keys, dense[keys], float(bias)


def hash_rows(texts: list[str | None]) -> list[tuple[list[int], list[int], list[int], list[int]]]:
    """Per text: distinct slots of its units, their numbers, slots of the units' single words, their numbers."""
    h = Hashed(texts)
    doc = np.array(h.doc, dtype=np.int64)
    out = []
    sets = []
    for unit, slot in ((h.unit, h.slot), (h.word_unit, h.word_slot)):
        pair = np.unique(unit * DIM + slot)
        lens = np.bincount(pair // DIM, minlength=len(doc))
        sets.append((pair % DIM, lens, np.concatenate(([0], np.cumsum(lens)))))
    bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
    for a, b in zip(bounds, bounds[1:]):
        row = []
        for slots, lens, ends in sets:
            row += [slots[ends[a] : ends[b]].tolist(), lens[a:b].tolist()]
        out.append(tuple(row))
    return out


def score_texts(texts: list[str | None], dense: np.ndarray, bias: float) -> np.ndarray:
    """Scores of many texts; a text without a unit scores 0."""
    h = Hashed(texts)
    worst = np.full(len(texts), -np.inf)
    np.maximum.at(worst, np.array(h.doc, dtype=np.int64), h.logits(dense))
    return np.where(np.isneginf(worst), 0.0, _sigmoid(worst + bias))


def fit(documents: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """The model of the labelled documents."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS)
    texts = documents.select("doc_id", "text").where(F.length("text").between(1, TRAIN_CHARS)).join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ints = pa.list_(pa.int32())
        for b in batches:
            cols = list(zip(*hash_rows(b.column(1).to_pylist()))) or [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, ints) for c in cols], b.column(2)], ["doc_id", "slots", "lens", "words", "n_words", "y"])

    slim = texts.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.col("y").cast("int").alias("y"))
    got = slim.mapInArrow(run, "doc_id bigint, slots array<int>, lens array<int>, words array<int>, n_words array<int>, y int").toArrow().sort_by("doc_id")
    parts = [[np.asarray(x.values) for x in got.column(c)] for c in ("slots", "lens", "words", "n_words")]
    return train(list(zip(*parts, [1 if y else 0 for y in got.column("y").to_pylist()])))


CHUNK = 256


def score(documents: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """(doc_id, source, score) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values, bias = model
        dense = np.zeros(DIM)
        dense[keys] = values
        for b in batches:
            texts = b.column(2).to_pylist()
            scores = [score_texts(texts[i : i + CHUNK], dense, bias) for i in range(0, len(texts), CHUNK)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.concatenate(scores) if scores else [], pa.float64())], ["doc_id", "source", "score"])

    slim = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", "text")
    return slim.mapInArrow(run, "doc_id bigint, source string, score double")


def source_name(col):
    """Column: a source's name without case, blanks and hyphens; unknown if null or blank."""
    name = F.regexp_replace(F.lower(F.trim(col)), r"[\s-]+", "_")
    return F.when(F.coalesce(name, F.lit("")) == "", F.lit("unknown")).otherwise(name)


def rates(scored: DataFrame) -> DataFrame:
    """Documents, cases, the rate and the mean score per source."""
    return scored.groupBy(source_name(F.col("source")).alias("source")).agg(
        F.count("*").alias("n_docs"), F.count_if(F.col("score") >= THRESHOLD).alias("n_toxic"), F.round(F.avg((F.col("score") >= THRESHOLD).cast("int")), 6).alias("rate"), F.round(F.avg("score"), 6).alias("mean_score")
    )

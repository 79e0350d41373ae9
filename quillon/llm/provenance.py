"""Generated, minified, vendored and data files among source code (problem 2).

Method: a random forest over compression ratio, token entropy, identifier lengths, comment density and kindred figures of the text without the comments at its top and
end, with a corpus figure: in how many repositories the same body stands. Its labels are notices in the comments at the top or the end of
a file, which are hidden from the features. Minified files and data carry no notices, so the positive examples also hold rows made here: a bounded sample of the bodies at hand is minified,
encoded, tabulated or expanded from a template (:func:`altered`). Rows without a notice are unlabelled, not negative: the forest is fitted on one row per distinct
body, the unlabelled bodies that it takes for cases are left out, and it is fitted again. It is assumed that most bodies without a notice are written by hand.

The body of a generated file may be like one written by hand, and then nothing but its notice tells. So a notice that is not denied stands as evidence beside the forest: the file's
score is the larger of the forest's and NOTICE. ``forest_score`` holds the forest's own.

Defined results: null and empty texts and files without a body beside comments are hand-written unless a notice says otherwise; licence texts, readmes, manifests, notes, key
files and kept configuration are no cases by their kind. With fewer than LEAST_BODIES bodies of either label no forest is fitted and notices alone count. Texts of any length are judged. Repeated rows get the same verdict; a null path has no kind. Extra columns are ignored.

Scale: one pass over the texts gives figures, a body hash and marks; only these small rows are shuffled. Copies are counted on distinct (hash, repository) pairs. The forest is fitted on
at most TRAIN_ROWS labelled rows and about MADE_ROWS made ones (documented bounds); counts and scores cover every row.
"""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.session import cut_lineage

TRAIN_ROWS = 40_000
MADE_ROWS, MADE_EACH, MADE_LEAST = 3_000, 8, 300
TREES, DEPTH, SEED = 24, 7, 7
THRESHOLD, NOTICE = 0.5, 0.95
#: Weight of a noticed body against an unlabelled one, weight of all made examples against all unlabelled bodies in the first and the second forest.
KNOWN, MADE_PARTS, DOUBTFUL = 5.0, (6.0, 1.5), 0.5
#: Least rows of a leaf in either forest: a number, and a share of the unlabelled bodies.
COARSE, FINE = (20, 0.01), (5, 0.0002)
LEAST_BODIES = 10

GENERATED = re.compile(
    r"(?i)@generated\b|\bauto[- ]?(?:matically[- ])?generated\b|\b(?:machine|tool)[- ](?:made|generated)\b|\bgenerated (?:by|from|with|using)\b|\bdo not (?:edit|modify|change)\b"
    r"|\boutput of `|\b(?:code|file) (?:was )?produced by\b|\b(?:hand |manual )?(?:edits|changes) (?:will|are going to) be (?:lost|overwritten)|\bautomatisch (?:erzeugt|generiert|erstellt)"
    r"|\bg[ée]n[ée]r[ée]e? automatiquement|\bgenerad[oa] autom[áa]ticamente|\bgerado automaticamente|\bregenerate with\b"
)
BY_HAND = re.compile(r"(?i)\b(?:written|edited|maintained|kept|made) by hand\b|\bhand[- ](?:written|edited|maintained|kept)|\bnot (?:auto[- ]?)?generated|\bwrites the\b|\bused to be generated")
VENDORED = re.compile(r"(?i)\bv?\d[\w.]* - upstream copy|\bimported unchanged from \S|\bvendored (?:copy of|from) \S|\(c\) the \S+ contributors|\bcopied (?:verbatim )?from \S+ v?\d")
#: Files that are never cases by their kind.
EXEMPT = re.compile(r"(?i)(^|/)((un)?licen[cs]e|copying|notice|readme|changelog|notes?)[^/]*$|\.(md|rst|txt|toml|ini|cfg|pem|key|env|yaml|yml|npmrc|netrc|pgpass|local|dockerfile|sh|lock|pub)$|(^|/)(dockerfile|makefile)$|(^|/)\.|(^|/)package\.json$|(^|/)(conf|config|settings)/[^/]+\.json$")
_LINE_COMMENT = r"(?://|#(?!\s*(?:include|define|if|pragma|endif|else))|\*|/\*|--|<!--|;)"
_COMMENT = re.compile(rf"^\s*{_LINE_COMMENT}|^\s*(?:<\?php|\*/|)\s*$")
_COMMENT_LINES = re.compile(rf"^[^\S\n]*{_LINE_COMMENT}", re.M)
_WORDS = re.compile(r"[^\W\d][\w$]*|\d[\w.]*")

FEATURES = [
    "ratio", "entropy", "ident_mean", "ident_max", "comment_share", "line_mean", "line_max", "digit_share", "space_share", "letter_share", "shape_share", "distinct_share", "log_size", "hex_share", "long_share",
]
CORPUS = ["copies"]

_PUNCT = np.array([33 <= b < 127 and not chr(b).isalnum() and b != 95 for b in range(256)])
_WORD_BYTES = bytes(b for b in range(256) if b >= 128 or chr(b).isalnum() or b in b"_ \t")


def parts(text: str) -> tuple[list[str], str]:
    """The comment lines at the top and the end, and the body between them without trailing blanks."""
    lines = text.replace("\r", "").removeprefix("﻿").removeprefix("ï»¿").split("\n")
    i, j = 0, len(lines)
    while i < j and _COMMENT.match(lines[i]):
        i += 1
    while j > i and _COMMENT.match(lines[j - 1]):
        j -= 1
    return [*lines[:i], *lines[j:]], "\n".join(map(str.rstrip, lines[i:j]))


def noticed(comments: list[str]) -> bool:
    """Whether the comments say that the file is generated or copied, and none says that it is kept by hand."""
    text = "\n".join(comments)
    return bool(GENERATED.search(text) or VENDORED.search(text)) and not BY_HAND.search(text)


def figures(body: str) -> list[float]:
    """The features of one body."""
    raw = body.encode("utf-8", "replace")
    codes = np.frombuffer(raw, dtype=np.uint8)
    hist = np.bincount(codes, minlength=256)
    n = max(1, len(raw))
    ends = np.flatnonzero(codes == 10)
    lengths = np.diff(np.concatenate(([-1], ends, [len(raw)]))) - 1
    counts = Counter(_WORDS.findall(body))
    many = np.concatenate((np.fromiter(counts.values(), dtype=np.int64, count=len(counts)), hist[_PUNCT & (hist > 0)]))
    total = max(1, int(many.sum()))
    idents = [(len(t), c) for t, c in counts.items() if not t[0].isdigit()]
    chars = sum(k * c for k, c in idents)
    shapes = Counter(filter(None, raw.translate(None, _WORD_BYTES).split(b"\n")))
    filled = max(1, sum(shapes.values()))
    hexes = sum(c for t, c in counts.items() if len(t) > 24 or len(t) > 2 and t[0] == "0" and t[1] in "xX")
    return [
        len(zlib.compress(raw, 1)) / n,
        float(-(many / total * np.log2(many / total)).sum()) if len(many) else 0.0,
        chars / max(1, sum(c for _, c in idents)),
        float(min(400, max((k for k, _ in idents), default=0))),
        len(_COMMENT_LINES.findall(body)) / len(lengths),
        float(lengths.mean()),
        float(min(5000, lengths.max())),
        float(hist[48:58].sum()) / n,
        float(hist[9] + hist[10] + hist[32]) / n,
        chars / n,
        sum(c for _, c in shapes.most_common(3)) / filled,
        len(many) / total,
        math.log10(n + 1),
        hexes / total,
        float(lengths[lengths > 300].sum()) / n,
    ]


# ---------------------------------------------------------------- examples made here

_KEPT = set("if else for while do return function var let const def class new in of and or not import from public static void int char true false null None True False export default switch case break continue try catch throw end".split())


def _minified(body: str, r: random.Random) -> str:
    """The body without comments and spare blanks, its names shortened, on one line or a few long ones."""
    names: dict[str, str] = {}
    letters = "abcdefghijklmnopqrstuvwxyz"

    def short(m: re.Match) -> str:
        word = m[0]
        if word in _KEPT or word[0].isdigit():
            return word
        if word not in names:
            k = len(names)
            names[word] = letters[k % 26] + (letters[k // 26 % 26] if k >= 26 else "") + (str(k // 676) if k >= 676 else "")
        return names[word]

    lines = [x.strip() for x in body.split("\n") if not _COMMENT_LINES.match(x)]
    text = re.sub(r"\s*([^\w\s])\s*", r"\1", " ".join(filter(None, lines)))
    if r.random() < 0.8:
        text = _WORDS.sub(short, text)
    # Bundles also hold constants: strings, numbers and small objects between the statements.
    pieces = re.split(r"(?<=[;}])", text) * r.choice([1, 1, 2, 4, 8])
    share, shorts = r.choice([0, 0.1, 0.3, 0.6]), list(names.values()) or ["x"]
    for i in range(len(pieces)):
        if r.random() < share:
            k, kind = r.choice(shorts), r.randrange(4)
            if kind == 0:
                pieces[i] += f"var {k}={{{k}:\"{base64.b64encode(r.randbytes(r.randint(3, 30))).decode()}\",n:{r.randint(0, 999)}}};"
            elif kind == 1:
                pieces[i] += f"var {k}=[{','.join(map(str, r.choices(range(10_000), k=r.randint(2, 12))))}];"
            elif kind == 2:
                pieces[i] += f"function {k}(a,b){{return a*{r.randint(1, 99)}+b>{r.randint(1, 999)}?a:b}}"
            else:
                pieces[i] += f"var {k}=function(o){{return o?o.{r.choice(shorts)}:null}};"
    text = "".join(pieces)
    if r.random() < 0.25:
        width = r.choice([500, 1000, 4000])
        return "\n".join(text[i : i + width] for i in range(0, len(text), width))
    return text


def _styles(words: list[str], r: random.Random, n: int) -> str:
    one = lambda: r.choice([f"margin:{r.randint(0, 40)}px", f"color:#{r.getrandbits(24):06x}", f"padding:{r.randint(0, 9)}em", "display:none", f"width:{r.randint(1, 100)}%"])
    return "".join(f".{r.choice(words).lower()}-{r.getrandbits(12):x}{{{';'.join(one() for _ in range(r.randint(1, 5)))}}}" for _ in range(n))


def _table(words: list[str], r: random.Random, n: int) -> str:
    """Literals alone: numbers, records or keys with values, on lines or in one."""
    kind, sep = r.randrange(6), r.choice(["\n    ", "\n  ", "\n\t", ""])
    bits, top = r.choice([32, 40, 48, 64]), 10 ** r.randint(2, 7)
    if kind == 0:
        rows = [f"[{r.uniform(0, 200):.5f},{r.uniform(0, 200):.5f}]" for _ in range(n)]
    elif kind == 1:
        rows = [f'"{r.getrandbits(bits):0{bits // 4}x}": {r.randint(0, top)}' for _ in range(n)]
    elif kind == 2:
        rows = [f'{{"{words[0]}": {i}, "{words[-1]}": "{r.choice(words)}", "w": {r.random():.3f}}}' for i in range(n)]
    elif kind == 3:
        rows = [", ".join(str(r.randint(0, 10 ** r.randint(1, 6))) for _ in range(10)) for _ in range(n // 6 + 3)]
    elif kind == 4:
        rows = [f'("{r.choice(words)}", {r.randint(0, 999)}, {r.choice(["True", "False", "null", "0.5"])})' for _ in range(n)]
    else:
        rows = [f'"{r.choice(words)} {r.choice(words)} {r.choice(words)}"' for _ in range(n)]
    head = r.choice(["var ", "const ", "", "", "static const int ", "export default "]) + r.choice([words[0], words[0].upper(), words[0] + "[]"])
    left, right = r.choice(["[]", "{}", "()"])
    body = ("," + (sep or r.choice(["", " "]))).join(rows) + (r.choice([",", ""]) if sep else "")
    return f"{head} = {left}{sep}{body}{chr(10) if sep else ''}{right}{r.choice([';', ''])}" + r.choice(["", "\n"])


def _blob(body: str, words: list[str], r: random.Random) -> str:
    """Bytes kept as code: an array of bytes, quoted lines of base64, or one long literal."""
    raw = zlib.compress(body.encode("utf-8", "replace")) * r.choice([1, 2, 4])
    kind, name = r.randrange(4), r.choice(words)
    if kind == 0:
        per = r.choice([8, 10, 12, 16])
        cells = [f"0x{b:02x}" if per != 10 else str(b) for b in raw]
        return f"static const unsigned char {name}[] = {{\n" + "".join("    " + ", ".join(cells[i : i + per]) + ",\n" for i in range(0, len(cells), per)) + "};"
    text = base64.b64encode(raw).decode() if kind < 3 else raw.hex()
    if kind == 1:
        per = r.choice([60, 64, 72, 76])
        return f"{name} = (\n" + "".join(f'    "{text[i : i + per]}"\n' for i in range(0, len(text), per)) + ")"
    return f"import {r.choice(words)}\n\n{name} = {r.choice(words)}({r.choice(['b', ''])}'{text}')\n\n" + "".join(f"{w} = {name}.{w}\n" for w in words[: r.randint(0, 6)])


def _template(words: list[str], r: random.Random, n: int) -> str:
    """One template over and over, as a tool writes it."""
    make = r.choice([
        lambda a, i: f"def get_{a}_{i}(msg):\n    return msg.fields[{i}]\n", lambda a, i: f"    public int get{a.capitalize()}{i}() {{ return this.{a}{i}; }}\n", lambda a, i: f"{a.upper()}_{i} = {i}\n",
        lambda a, i: f"    case {i}: return \"{a}\";\n", lambda a, i: f"export const {a}{i} = registry.field({i}, \"{a}\");\n", lambda a, i: f"func (m *Msg) {a.capitalize()}{i}() int {{\n    return m.f[{i}]\n}}\n",
    ])
    return "\n".join(make(r.choice(words), i) for i in range(n))


def altered(body: str, seed: int) -> str:
    """A case made of a body: minified, encoded, tabulated or expanded from a template. The same seed gives the same text. Those under MADE_LEAST characters are no examples."""
    r = random.Random(seed)
    words = [w for w in dict.fromkeys(re.findall(r"[A-Za-z_]{3,14}", body)) if w not in _KEPT][:200] or ["value", "name"]
    r.shuffle(words)
    kind, n = r.randrange(10), int(10 * 60 ** r.random())
    if kind < 4:
        return _minified(body, r)
    if kind == 4:
        return _styles(words, r, n)
    if kind < 7:
        return _table(words, r, n)
    return _blob(body, words, r) if kind < 9 else _template(words, r, n)


_SCHEMA = "file_id bigint, repo_id string, body_hash string, noticed boolean, judged boolean, made_id bigint, " + ", ".join(f"{f} double" for f in FEATURES)


def measure(files: DataFrame, made_share: float, each: int = 1) -> DataFrame:
    """One small row per file (figures, body hash, marks), and one per made example: ``each`` of every file of the share ``made_share``, chosen by hash."""
    names = ["file_id", "repo_id", "body_hash", "noticed", "judged", "made_id", *FEATURES]
    types = [pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.int64(), *[pa.float64()] * len(FEATURES)]
    none = [0.0] * len(FEATURES)

    def rows_of(fid: int | None, repo: str | None, path: str | None, text: str | None, seed: int | None) -> Iterator[list]:
        if not text or (path and EXEMPT.search(path)):
            yield [fid, repo, None, False, False, None, *none]
            return
        comments, body = parts(text)
        judged = bool(body.strip())
        digest = hashlib.blake2b(body.encode("utf-8", "replace"), digest_size=12).hexdigest() if judged else None
        yield [fid, repo, digest, noticed(comments), judged, None, *(figures(body) if judged else none)]
        for k in range(each if judged and seed is not None else 0):
            made = altered(body, seed + k)
            if len(made) >= MADE_LEAST:
                yield [None, None, None, True, True, seed + k, *figures(made)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [row for args in zip(*(c.to_pylist() for c in b.columns)) for row in rows_of(*args)]
            cols = list(zip(*rows)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    draw = F.pmod(F.xxhash64("file_id", F.lit(SEED)), F.lit(1_000_000))
    seed = F.when(draw < int(made_share * 1_000_000), F.pmod(F.xxhash64("file_id"), F.lit(1 << 40)))
    slim = files.select(F.col("file_id").cast("bigint").alias("file_id"), "repo_id", "file_path", "raw_content")
    return slim.withColumn("seed", seed).mapInArrow(run, _SCHEMA)


def corpus_features(measured: DataFrame) -> DataFrame:
    """Adds copies (repositories that hold the same body, at most 5 counted) and body_noticed (whether any file with that body has a notice; a label, no feature)."""
    hashed = measured.where(F.col("body_hash").isNotNull())
    per = hashed.groupBy("body_hash", F.coalesce("repo_id", F.lit("")).alias("r")).agg(F.bool_or("noticed").alias("s"))
    bodies = per.groupBy("body_hash").agg(F.least(F.count("*"), F.lit(5)).cast("double").alias("copies"), F.bool_or("s").alias("body_noticed"))
    # Rows without a body must not meet in one partition, so each gets a key of its own.
    keyed = measured.withColumn("body_hash", F.coalesce("body_hash", F.concat(F.lit("-"), F.coalesce("file_id", "made_id").cast("string"))))
    out = keyed.join(bodies, "body_hash", "left")
    return out.withColumn("copies", F.coalesce("copies", F.lit(1.0))).withColumn("body_noticed", F.coalesce("body_noticed", "noticed"))


def classify(files: DataFrame) -> DataFrame:
    """(file_id, noticed, forest_score, score, is_case) of every row."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    n_files = max(1, files.count())
    each = min(MADE_EACH, max(1, MADE_ROWS // n_files))
    rows = corpus_features(cut_lineage(measure(files, min(1.0, MADE_ROWS / n_files), each)))
    names = [*FEATURES, *CORPUS]
    assembled = VectorAssembler(inputCols=names, outputCol="x").transform(rows.where("judged"))
    # One row per distinct body, weighted by its files, so that a leaf holds several bodies and not one that is copied everywhere.
    bodies = assembled.groupBy("body_hash").agg(
        F.first("x").alias("x"), F.bool_or("body_noticed").cast("double").alias("label"), F.bool_or(F.col("made_id").isNotNull()).alias("made"), F.count("*").cast("double").alias("n"), (F.max("copies") > 1).alias("copied")
    )
    bodies = bodies.persist()
    kind = F.when(F.col("made"), "made").when(F.col("label") > 0, "noticed").otherwise("unlabelled")
    sizes = {(r.kind, r.copied): r for r in bodies.groupBy(kind.alias("kind"), "copied").agg(F.count("*").alias("bodies"), F.sum("n").alias("files")).collect()}
    total = lambda of, what: sum(getattr(r, what) for k, r in sizes.items() if k[0] == of)
    n_free, n_known = total("unlabelled", "files"), total("noticed", "bodies")
    slim = assembled.where("made_id is null")
    if total("unlabelled", "bodies") < LEAST_BODIES or n_known + total("made", "bodies") < LEAST_BODIES:
        scored = slim.select("file_id", "noticed", F.lit(0.0).alias("forest_score"))
    else:
        # Weights and least leaves follow the counts, so the forest is the same at every size of the corpus. Bodies in several repositories are few and drawn apart.
        share = {c: min(1.0, TRAIN_ROWS / 2 / max(1, sum(r.bodies for k, r in sizes.items() if k[0] != "made" and k[1] == c))) for c in (False, True)}
        drawn = F.pmod(F.xxhash64("body_hash", F.lit(SEED)), F.lit(1_000_000)) < F.when(F.col("copied"), int(share[True] * 1_000_000)).otherwise(int(share[False] * 1_000_000))
        train = bodies.where(F.col("made") | drawn)
        share_n = F.when(F.col("copied"), 1 / share[True]).otherwise(1 / share[False]) * F.col("n")
        weighted = lambda rows, part: rows.withColumn("w", F.when(F.col("made"), float(part * n_free / max(1, total("made", "bodies")))).when(F.col("label") > 0, KNOWN * share_n).otherwise(share_n))
        forest = lambda depth, least, some: RandomForestClassifier(featuresCol="x", labelCol="label", weightCol="w", numTrees=TREES, maxDepth=depth, maxBins=64, minInstancesPerNode=max(least[0], int(least[1] * total('unlabelled', 'bodies') * share[False])), seed=SEED, featureSubsetStrategy=some, subsamplingRate=0.8)
        # The first forest is coarse, so that it cannot learn the single unlabelled cases by heart, and sees made cases only, which are never like hand-written bodies.
        first = forest(4, COARSE, "0.5").fit(weighted(train.where("made or label = 0"), MADE_PARTS[0]))
        chance = vector_to_array("probability")[1]
        # Of bodies smaller than any made example the first forest knows nothing.
        small = vector_to_array("x")[FEATURES.index("log_size")] < math.log10(MADE_LEAST)
        sure = first.transform(train).where((F.col("label") > 0) | (chance < DOUBTFUL) | small).select("x", "label", "made", "n", "copied")
        model = forest(DEPTH, FINE, "0.5").fit(weighted(sure, MADE_PARTS[1]))
        scored = model.transform(slim).select("file_id", "noticed", chance.alias("forest_score"))
    bodies.unpersist()
    rest = rows.where("not judged").select("file_id", "noticed", F.lit(0.0).alias("forest_score"))
    score = F.greatest("forest_score", F.when(F.col("noticed"), NOTICE).otherwise(0.0))
    return scored.unionByName(rest).withColumn("score", score).withColumn("is_case", F.col("score") >= THRESHOLD)


def found(files: DataFrame) -> DataFrame:
    return classify(files).where("is_case").select("file_id").distinct()

"""License of each code file and repository (problem 5).

Method: statement templates with optional ``[...]``, alternative ``{a|b}`` and replaceable ``<name>`` sections
are compiled into backtracking grammars. Comment text (and license files, manifests, readme sections)
must match a template completely. The wordings of ``license_refs`` become grammars as well: copyright lines and the title are optional sections, every sentence is a clause, ``<...>`` in it is replaceable, and a comment
paragraph states a license if it is a sequence of at least CLAUSES clauses of that one license. A license file states it by more than half of its clauses, so that one left out or reworded does
not hide it. Stated licenses are then aggregated per repository and file and contradictions become CONFLICT.

Defined results: null or empty contents state nothing; a repository without files is UNKNOWN; "-only" and "or later" are
dropped; a choice of two is written in alphabetical order joined by `` OR ``. Pointers to other files, bare copyright lines, plans and
words about other software's license are no statements. Repeated rows (re-crawls) state what they hold again, which changes nothing;
a null repo_id or file_path gives no directory, so such a file has its own statement or UNKNOWN. Extra columns are ignored.

Scale: texts stay where they are read; only (repo, directory, license) rows are shuffled. Directories are made distinct
before their ancestors are expanded, and both joins have one row per key on one side, so a hot repository is
split by adaptive skew handling. ``license_refs`` is a fixed table of wordings, checked against MAX_REFS before it is sent to the workers.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.session import cut_lineage

MAX_REFS = 2_000
CLAUSES = 2

_VER = {n: f"[{{,|-| |version |v}}{{ |}}][{{v|version }}]{n}[.0]" for n in "123"}
#: Spellings of license names (fixed values); matched without regard to case.
NAMES = {
    "MIT": ["[the ][expat (]mit[)][ {license|licence}][ terms]", "[the ]expat[ {license|licence}]"],
    "Apache-2.0": ["[the ]apache[ software][ {license|licence}][,][ ][-][{v|version}][ ]2[.0][ {license|licence}]"],
    "BSD-3-Clause": [
        "bsd[ ][-]3[-clause][ {license|licence}]", "[the ]{3|three}-clause bsd[ {license|licence}]", "[the ]{new|modified|revised} bsd[ {license|licence}]",
        "[the ]bsd 3-clause[ {license|licence}]", "[the ]bsd-style {license|licence} with three clauses", "[the ]bsd {license|licence} with three clauses",
    ],
    "BSD-2-Clause": [
        "bsd[ ][-]2[-clause][ {license|licence}]", "[the ]{2|two}-clause bsd[ {license|licence}]", "[the ]{simplified|freebsd} [bsd ][{license|licence}]", "[the ]simplified bsd",
        "[the ]bsd 2-clause[ {license|licence}]", "[the ]bsd-style {license|licence} with two clauses", "[the ]bsd {license|licence} with two clauses",
    ],
    "ISC": ["[the ]isc[ {license|licence}][ terms]"],
    "MPL-2.0": ["[the ]{mpl|mozilla public {license|licence}}[,][ ][-][{v|version}][ ]2[.0]"],
    "GPL-2.0": ["[the ][gnu ]{gpl|general public {license|licence}}[,][ ][-][{v|version}][ ]2[.0]"],
    "GPL-3.0": ["[the ][gnu ]{gpl|general public {license|licence}}[,][ ][-][{v|version}][ ]3[.0]"],
    "LGPL-3.0": ["[the ][gnu ]{lgpl|{lesser|library} {gpl|general public {license|licence}}}[,][ ][-][{v|version}][ ]3[.0]"],
    "AGPL-3.0": ["[the ][gnu ]{agpl|affero {gpl|general public {license|licence}}}[,][ ][-][{v|version}][ ]3[.0]"],
    "SSPL-1.0": ["[the ]{sspl|server side public {license|licence}}[,][ ][-][{v|version}][ ]1[.0]"],
    "Unlicense": ["[the ]unlicense[ {license|licence|terms}]"],
}
LATER = "[+][{-|[,] }{only|or{ |-}[any ]later[ version]|or newer|or, at your option, any later version}]"
#: Statements in comments; <L> is a license, or two joined by "or"; the rest may be any text of one line.
STATEMENTS = [
    "[@]license[s][:] <L>", "@licence[:] <L>", "spdx-license-identifier[ ]: <L>", "{license|licence|licensing}[ ]: <L>",
    "use, copying and changes are governed by the <L>; <any>", "copyright <any>[.] {offered to you|licensed|released|distributed|provided} {on|under} the terms of the <L>[ and nothing else]",
    "[<who> is ]{released|licensed|distributed|published|available|provided|offered} {under|on|by} [the terms of ][the ]<L>[ and nothing else][; <any>]",
    "this {file|project|program|software|code|work|library|module|package|source[ file]} is {released |licensed |distributed |published |available |provided |}{under|on} [the terms of ][the ]<L>[; <any>]",
    "publicado bajo la licencia[ ]: <L>", "distribu<e> sous licence[ ]: <L>", "lizenziert unter[ ]: <L>",
    "[{//|#} ]__license__ = {\"|'}<L>{\"|'}", "subject to the [terms of the ]<L>[; <any>]", "governed by the [terms of the ]<L>[; <any>]", "under the [terms of the ]<L>[; <any>]",
]
#: What a readme's license section or a manifest's field may say.
SECTION = ["[the ]<L>", "<L>, no other terms", "[this {project|software|code|package|repository|library|work} is ][{released|licensed|distributed|available} ]{under|on} [the terms of ][the ]<L>", *STATEMENTS]


def _grammar(template: str) -> str:
    """A template as a pattern for the backtracking matcher."""
    out, i = [], 0
    while i < len(template):
        ch = template[i]
        if ch == "[":
            out.append("(?:")
        elif ch == "]":
            out.append(")?")
        elif ch == "{":
            out.append("(?:")
        elif ch == "}":
            out.append(")")
        elif ch == "|":
            out.append("|")
        elif ch == "<":
            end = template.index(">", i)
            out.append({"L": "(?P<L>LICENSE)", "any": r".*?", "who": r"[\w .-]+?", "e": r"\S{1,4}"}[template[i + 1 : end]])
            i = end
        elif ch == " ":
            out.append(r"\s+")
        else:
            out.append(re.escape(ch))
        i += 1
    return "".join(out)


@lru_cache(maxsize=1)
def _compiled() -> tuple[re.Pattern, re.Pattern, list, list]:
    later = _grammar(LATER)
    one = "|".join(f"(?P<N{i}_{j}>(?:{_grammar(t)}))" for i, (_, ts) in enumerate(NAMES.items()) for j, t in enumerate(ts))
    name = re.compile(f"(?:{one})(?:{later})", re.I)
    plain = re.sub(r"\(\?P<\w+>", "(?:", one)
    both = rf"\(?(?:{plain})(?:{later})(?:\s+or\s+(?:the\s+)?(?:{plain})(?:{later})|\s*/\s*(?:{plain})(?:{later}))?\)?(?:,?\s+at\s+your\s+(?:option|choice))?"
    either = re.compile(rf"\(?(?P<a>(?:{plain})(?:{later}))(?:(?:\s+or\s+(?:the\s+)?|\s*/\s*)(?P<b>(?:{plain})(?:{later})))?\)?(?:,?\s+at\s+your\s+(?:option|choice))?", re.I)
    make = lambda ts: [regex.compile(_grammar(t).replace("LICENSE", both) + r"[.,;]?", regex.I | regex.V0) for t in ts]
    return name, either, make(STATEMENTS), make(SECTION)


@lru_cache(maxsize=65536)
def license_id(text: str) -> str | None:
    """The id, or two ids joined by OR, that a name or expression stands for."""
    name, either, _, _ = _compiled()
    m = either.fullmatch(" ".join(text.split()))
    if not m:
        return None
    ids = set()
    for part in (m["a"], m["b"]):
        if part:
            hit = name.fullmatch(part)
            if not hit:
                return None
            group = next(k for k, v in hit.groupdict().items() if v is not None)
            ids.add(list(NAMES)[int(group[1:].split("_")[0])])
    return " OR ".join(sorted(ids))


def _match(text: str, grammars: list) -> tuple[str | None, bool]:
    """(license stated, whether the text may be the beginning of a statement)."""
    alive = False
    for g in grammars:
        m = g.fullmatch(text, partial=True)
        if m and not m.partial:
            return license_id(m["L"]), True
        alive |= bool(m)
    return None, alive


@lru_cache(maxsize=65536)
def statement(text: str) -> tuple[str | None, bool]:
    """License stated by one piece of comment text that matches a template completely."""
    return _match(text, _compiled()[2])


@lru_cache(maxsize=65536)
def section_statement(text: str) -> tuple[str | None, bool]:
    return _match(text, _compiled()[3])


def statements(lines: list[str], match: Callable[[str], tuple[str | None, bool]]) -> set[str]:
    """Licenses stated by any run of lines without a blank one between them; a run is followed as long as it may become a statement."""
    out: set[str] = set()
    i = 0
    while i < len(lines):
        piece, step = "", 1
        for j in range(i, len(lines)):
            line = " ".join(lines[j].split())
            if not line:
                break
            piece = f"{piece} {line}" if piece else line
            got, alive = match(piece)
            if got:
                out.add(got)
                step = j + 1 - i
            if got or not alive:
                break
        i += step
    return out


_MARK = re.compile(r"^\s*(?:(?://+[!]?|/?\*+/?|#+(?!include|!)|--|;+|<!--|\"\"\"|'''|=begin)\s?|(?=__license__))(.*?)\s*(?:\*/|-->|\"\"\"|''')?\s*$")
_HINT = re.compile(r"(?i)licen[cs]|lizenz|spdx|govern|terms|under|released|published|distributed|available|provided|offered|subject to")
_WORD = re.compile(r"[^\W_]+")


def comment_blocks(text: str) -> list[list[str]]:
    """Runs of comment lines without their markers."""
    blocks: list[list[str]] = []
    last = -2
    inside = False
    for n, line in enumerate(text.removeprefix("\ufeff").removeprefix("\u00ef\u00bb\u00bf").split("\n")):
        bare = line.strip()
        m = _MARK.match(line)
        if m or inside:
            body = m[1] if m else bare.removesuffix("*/").strip()
            if n != last + 1:
                blocks.append([])
            blocks[-1].append(body.strip())
            last = n
        if bare.startswith("/*") and "*/" not in bare:
            inside = True
        elif "*/" in bare:
            inside = False
    return blocks


def words(text: str) -> str:
    return " ".join(_WORD.findall(text.lower()))


_COPYRIGHT = re.compile(r"(?i)^\W*(?:copyright|\(c\)|©|all rights reserved)")
_SENTENCE = re.compile(r"(?<=[.!?;])\s+|\n\s*\n")


class Wordings:
    """Grammars of the reference wordings, made of their clauses."""

    def __init__(self, refs: list[tuple[str, str | None, str | None]]) -> None:
        self.titles = {words(title): i for i, title, _ in refs if title}
        self.clauses: dict[str, list[re.Pattern]] = {}
        self.grammars: list[tuple[str, re.Pattern]] = []
        starts, self.telling = set(), set()
        for i, title, text in refs:
            parts = [x for x in _SENTENCE.split(text or "") if words(x)]
            if not parts:
                continue
            made = [self._clause(x) for x in parts]
            self.clauses[i] = [re.compile(f" {c} ") for c in made]
            name = re.escape(words(title)) + " " if title else ""
            self.grammars.append((i, re.compile(f"(?:{name})?((?:(?:{'|'.join(sorted(made, key=len, reverse=True))})(?: |$))+)")))
            self.telling |= {max(w, key=lambda x: (len(x), x)) for x in parts if (w := words(re.sub(r"<[^<>]*>|\[[^\[\]]*\]", " ", x)).split())}
            starts |= {tuple(words(re.split(r"[<\[]", x)[0]).split()[:2]) for x in parts} - {()}
        self.starts = {" ".join(x) for x in starts}
        self.started = re.compile("|".join(rf"\b{re.escape(x)}\b" for x in sorted(self.starts)) or r"(?!)")

    @staticmethod
    def _clause(text: str) -> str:
        """A sentence as a pattern over words; <...> and [...] stand for any words."""
        out = [re.escape(words(p)) if k % 2 == 0 else r"\w+(?: \w+)*?" for k, p in enumerate(re.split(r"(<[^<>]+>|\[[^\[\]]+\])", text))]
        return " ".join(filter(None, out))

    def hints(self) -> list[str]:
        """Words of which every text with a clause holds one, for a filter: the longest word of each clause."""
        return sorted(self.telling)

    def comment(self, lines: list[str]) -> str | None:
        """The one license of which a paragraph holds nothing but clauses."""
        rest = words(" ".join(x for x in lines if not _COPYRIGHT.match(x)))
        first = rest.split(" ", 2)[:2]
        if " ".join(first) not in self.starts and not any(rest.startswith(t) for t in self.titles):
            return None
        hits = set()
        for i, g in self.grammars:
            if g.fullmatch(rest) and sum(bool(c.search(f" {rest} ")) for c in self.clauses[i]) >= min(CLAUSES, len(self.clauses[i])):
                hits.add(i)
        return hits.pop() if len(hits) == 1 else None

    def inside(self, text: str, whole: bool = False) -> set[str]:
        """Licenses of which more than half of the clauses, or all, stand in a text."""
        flat = f" {words(text)} "
        if not self.started.search(flat):
            return set()
        return {i for i, cs in self.clauses.items() if sum(bool(c.search(flat)) for c in cs) * 2 > (2 * len(cs) - 1 if whole else len(cs))}


def paragraphs(block: list[str]) -> Iterator[list[str]]:
    part: list[str] = []
    for line in [*block, ""]:
        if line.strip():
            part.append(line)
        elif part:
            yield part
            part = []


def comment_licenses(text: str, wordings: Wordings) -> set[str]:
    """Licenses stated in comments: by a template, by nothing but clauses of a license, or by all of its clauses among other text."""
    out: set[str] = set()
    for block in comment_blocks(text):
        got = {x for part in paragraphs(block) if (x := wordings.comment(part))}
        out |= got or wordings.inside(" ".join(block), whole=True)
        if _HINT.search(" ".join(block)):
            out |= statements(block, statement)
    return out


_CHOICE = re.compile(r"(?i)\b(?:either|any|one|both)\s+of\s+[\w\s]*?licen[cs]es?\b|at\s+your\s+(?:choice|option)|dual[- ]licen[cs]ed")


def text_licenses(text: str, wordings: Wordings) -> set[str]:
    """What a license file holds: wordings; else titles, names and statements on its lines."""
    out = wordings.inside(text)
    if not out:
        lines = [x.strip(" \t\r#*=-").strip() for x in text.split("\n")]
        out = {wordings.titles[w] for x in lines if (w := words(x)) in wordings.titles} | statements(lines, section_statement)
    if len(out) == 2 and _CHOICE.search(text):
        return {" OR ".join(sorted(out))}
    return out


def manifest_license(name: str, text: str) -> set[str]:
    value: object = None
    if name.endswith(".json"):
        try:
            doc = json.loads(text)
        except ValueError:
            return set()
        if isinstance(doc, dict):
            value = doc.get("license")
            if value is None and isinstance(doc.get("licenses"), list):
                got = {x for v in doc["licenses"] if isinstance(v, dict) and (x := license_id(str(v.get("type"))))}
                return got
    else:
        import tomllib

        try:
            doc = tomllib.loads(text)
        except ValueError:
            return set()
        for key in ("project", "package"):
            if isinstance(doc.get(key), dict):
                value = doc[key].get("license", value)
        if value is None and isinstance(doc.get("tool"), dict):
            poetry = doc["tool"].get("poetry")
            value = poetry.get("license") if isinstance(poetry, dict) else None
    if isinstance(value, dict):
        value = value.get("text") or value.get("type")
    got = license_id(value) if isinstance(value, str) else None
    return {got} if got else set()


_HEAD = re.compile(r"(?i)^(?:#+\s*)?(licen[cs](?:e|ing|ia)|licence|lizenz)s?\s*:?\s*#*$")
_ANY_HEAD = re.compile(r"^#{1,6}\s+\S")


def readme_license(text: str) -> set[str]:
    """Statements in a readme's license section (a heading and what follows, up to the next heading)."""
    section: list[str] = []
    lines = [x.strip() for x in text.replace("\r", "").split("\n")]
    inside = False
    for i, line in enumerate(lines):
        underlined = i + 1 < len(lines) and bool(re.fullmatch(r"=+|-+|~+", lines[i + 1])) and bool(line)
        if _HEAD.match(line) and (line.startswith("#") or underlined):
            inside = True
        elif _ANY_HEAD.match(line) or underlined:
            inside = False
        section.append(line if inside and not _HEAD.match(line) else "")
    return statements(section, section_statement)


_LICENSE_FILE = re.compile(r"(?i)^(un)?(licen[cs]e|copying)([-_.].*)?$")
_MANIFESTS = ("package.json", "pyproject.toml", "cargo.toml")
_PLAIN = (".md", ".rst", ".txt", ".json", ".csv", ".html")
_STATED = "file_id bigint, repo_id string, dir string, is_license boolean, is_root_statement boolean, stated array<string>"


#: Lower-case words of which every statement by a template holds one.
HINTS = ["licen", "lizenz", "spdx", "governed", "terms", "copyright", "under", "released", "published", "distributed", "available", "provided", "offered", "subject to"]


def _finder(marks: list[str]):
    """A test whether a text holds one of the marks without regard to case, in one pass."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for m in marks:
        automaton.add_word(m, True)
    automaton.make_automaton()
    return lambda text: next(automaton.iter(text.lower()), None) is not None


def stated(files: DataFrame, refs: DataFrame) -> DataFrame:
    """What every file states: file_id, repo_id, dir (null: unknown, '': root), is_license, is_root_statement, stated.

    Files without any licensing word or word of a clause are settled by one pass of an automaton over their text.
    """
    rows = refs.select("license_id", "title", "reference_text").limit(MAX_REFS + 1).collect()
    if len(rows) > MAX_REFS:
        raise ValueError(f"license_refs has more than {MAX_REFS} rows")
    known = sorted(((r.license_id, r.title, r.reference_text) for r in rows if r.license_id), key=lambda r: tuple(x or "" for x in r))
    hints = [*HINTS, *Wordings(known).hints()]

    def look(path: str | None, text: str | None, wordings: Wordings, holds: Callable[[str], bool]) -> tuple[bool, bool, list[str]]:
        name = (path or "").rsplit("/", 1)[-1]
        low = name.lower()
        root = path is not None and "/" not in path
        text = text or ""
        if _LICENSE_FILE.match(name):
            return True, root, sorted(text_licenses(text, wordings))
        if root and low in _MANIFESTS:
            return False, True, sorted(manifest_license(low, text))
        if root and low.startswith("readme"):
            return False, True, sorted(readme_license(text))
        if low.endswith(_PLAIN) or low.startswith("readme"):
            return False, False, []
        return False, False, sorted(comment_licenses(text, wordings)) if holds(text) else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wordings, holds = Wordings(known), _finder(hints)
        for b in batches:
            got = [look(p, t, wordings, holds) for p, t in zip(b.column(3).to_pylist(), b.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array([g[0] for g in got], pa.bool_()), pa.array([g[1] for g in got], pa.bool_()), pa.array([g[2] for g in got], pa.list_(pa.string()))],
                ["file_id", "repo_id", "dir", "is_license", "is_root_statement", "stated"],
            )

    path = F.col("file_path")
    base = files.select(
        F.col("file_id").cast("bigint").alias("file_id"), "repo_id", F.regexp_extract(path, r"^(.*)/[^/]*$", 1).alias("dir"), "file_path",
        # Plain texts that are no license, manifest or readme state nothing, so theirs stay in the JVM.
        F.when(F.lower(path).rlike(r"(^|/)(un)?(licen[cs]e|copying)|(^|/)readme|(^|/)(package\.json|pyproject\.toml|cargo\.toml)$") | ~F.lower(F.coalesce(path, F.lit(""))).rlike(r"\.(md|rst|txt|json|csv|html)$"), F.col("raw_content")).alias("raw_content"),
    )
    touched = base.where(F.col("raw_content").isNotNull()).mapInArrow(run, _STATED)
    rest = base.where(F.col("raw_content").isNull()).select(
        "file_id", "repo_id", "dir", F.lit(False).alias("is_license"), F.lit(False).alias("is_root_statement"), F.array().cast(T.ArrayType(T.StringType())).alias("stated")
    )
    return touched.unionByName(rest)


def _settle(sets) -> F.Column:
    """UNKNOWN for none, the license for one, CONFLICT for more."""
    return F.when(F.size(sets) == 0, F.lit("UNKNOWN")).when(F.size(sets) == 1, F.element_at(sets, 1)).otherwise(F.lit("CONFLICT"))


def resolve(files: DataFrame, repos: DataFrame, refs: DataFrame) -> DataFrame:
    """(scope, item, license) for every repository of repos and every row of files."""
    facts = cut_lineage(stated(files, refs))  # small rows, read several times
    per_repo = facts.where("is_root_statement").select("repo_id", F.explode("stated").alias("l")).distinct()
    repo_result = per_repo.groupBy("repo_id").agg(_settle(F.collect_set("l")).alias("repo_license"))
    repo_rows = repos.select("repo_id").distinct().join(repo_result, "repo_id", "left")
    repo_rows = repo_rows.select(F.lit("repo").alias("scope"), F.col("repo_id").alias("item"), F.coalesce("repo_license", F.lit("UNKNOWN")).alias("license"))

    # The nearest directory, at or above its own but below the root, that has a license file which states something.
    license_dirs = (
        facts.where(F.col("is_license") & (F.col("dir") != "") & (F.size("stated") > 0))
        .select("repo_id", F.col("dir").alias("up"), F.explode("stated").alias("l"))
        .groupBy("repo_id", "up")
        .agg(_settle(F.collect_set("l")).alias("dir_license"))
    )
    dirs = facts.where(F.col("dir") != "").select("repo_id", "dir").distinct()
    parts = F.split("dir", "/")
    ups = dirs.withColumn("n", F.explode(F.sequence(F.lit(1), F.size(parts)))).withColumn("up", F.array_join(F.slice(parts, F.lit(1), F.col("n")), "/"))
    nearest = ups.join(license_dirs, ["repo_id", "up"]).groupBy("repo_id", "dir").agg(F.max_by("dir_license", "n").alias("dir_license"))

    own = F.array_distinct("stated")
    governing = F.coalesce("dir_license", "repo_license", F.lit("UNKNOWN"))
    joined = facts.join(nearest, ["repo_id", "dir"], "left").join(repo_result, "repo_id", "left")
    clash = (F.size(own) > 1) | (~governing.isin("CONFLICT", "UNKNOWN") & (governing != F.element_at(own, 1)))
    result = F.when(F.size(own) == 0, governing).when(clash, F.lit("CONFLICT")).otherwise(F.element_at(own, 1))
    file_rows = joined.select(F.lit("file").alias("scope"), F.col("file_id").cast("string").alias("item"), result.alias("license"))
    return repo_rows.unionByName(file_rows).distinct()

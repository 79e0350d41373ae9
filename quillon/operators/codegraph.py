"""The graph of classes, functions, imports, bases and calls that source files declare.

Every file yields facts where it is read: (fact, owner, name, line). Python is read from its syntax tree, JavaScript from its tokens; files in other languages or that do not parse yield no facts of this graph. Nodes
and edges are relational work on the facts: only these small rows are shuffled, by (repository, ref, node), and texts never move. Of several crawls of a path in a ref the last counts.

Defined results: null and empty texts yield a file node alone in a language with a graph, and nothing in others. Edges keep what the source says: the module's name, the base or the called expression as written.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import paths

#: (kind, owner: the class around it or None, name, line)
Fact = tuple[str, str | None, str, int]


def _written(node: ast.AST) -> str:
    """An expression as written: names and attributes plainly, literals by their value, all else as Python prints it."""
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        return f"{_written(node.value)}.{node.attr}"
    if isinstance(node, ast.Constant):
        return str(node.value)
    try:
        return ast.unparse(node)
    except (ValueError, RecursionError):
        return f"<{type(node).__name__}>"


def python_facts(text: str) -> list[Fact] | None:
    """Facts of a Python file in the order of its text; None if it does not parse."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    out: list[Fact] = []
    todo: list[tuple[ast.AST, str | None]] = [(tree, None)]
    while todo:
        node, owner = todo.pop()
        inside = owner
        match node:
            case ast.Import(names=names):
                out += [("import", None, a.name, node.lineno) for a in names]
            case ast.ImportFrom(module=module, names=names):
                out += [("import", None, module or ".", node.lineno) for _ in names]
            case ast.ClassDef(name=name, bases=bases):
                out.append(("class", None, name, node.lineno))
                out += [("base", name, _written(b), node.lineno) for b in bases]
                inside = name
            case ast.FunctionDef(name=name):
                out.append(("method" if owner else "function", owner, name, node.lineno))
            case ast.Call(func=func):
                out.append(("call", owner, _written(func), node.lineno))
        todo += [(child, inside) for child in reversed(list(ast.iter_child_nodes(node)))]
    return out


#: Comments, strings, templates, regular expressions behind an operator, names, numbers, and single signs.
_JS = re.compile(
    r"""(?P<text>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`|(?<=[=(,:!&|?{};\n])\s*/(?![/*\s])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*)|(?P<gap>\s+|//[^\n]*|/\*.*?\*/)|(?P<name>[A-Za-z_$][\w$]*)|(?P<sign>=>|\?\.|\d[\w.]*|.)""",
    re.S,
)
#: Words before a parenthesis that are no calls.
_NO_CALL = set("if for while switch catch function return typeof instanceof in of new delete void await yield do else case throw with super import".split())


def javascript_facts(text: str) -> list[Fact]:
    """Facts of a JavaScript file: required and imported modules, functions, arrow functions bound to a name, classes, calls and exported functions."""
    tokens = [(m.lastgroup, m[0].strip(), m.start()) for m in _JS.finditer(text) if m.lastgroup != "gap"]
    starts, close = [m.end() for m in re.finditer("\n", text)], _closings(tokens)
    out: list[Fact] = []
    at = lambda i: tokens[i] if 0 <= i < len(tokens) else ("end", "", len(text))
    line = 0
    for i, (kind, word, place) in enumerate(tokens):
        while line < len(starts) and starts[line] <= place:
            line += 1
        if kind != "name":
            continue
        before, after = at(i - 1), at(i + 1)
        put = lambda what, name: out.append((what, None, name, line + 1))
        member = before[1] in (".", "?.")
        if word == "require" and not member and after[1] == "(" and at(i + 2)[0] == "text" and at(i + 3)[1] == ")":
            put("import", at(i + 2)[1][1:-1])
        elif word == "import" and not member and after[1] != "(":
            j = i + 1
            while at(j)[0] in ("name", "sign") and at(j)[1] not in (";", "(") and at(j - 1)[1] != "from":
                j += 1
            if at(j)[0] == "text" and (j == i + 1 or at(j - 1)[1] == "from"):
                put("import", at(j)[1][1:-1])
        elif before[1] == "class" and at(i - 2)[1] not in ("=", "(", ",", ":", "return"):
            put("class", word)
        elif before[1] == "function" or before[1] == "*" and at(i - 2)[1] == "function":
            k = i - 1 if before[1] == "function" else i - 2
            k -= at(k - 1)[1] == "async"
            if at(k - 1)[1] in ("", ";", "{", "}", ")", "export", "default"):
                put("function", word)
                if at(k - 1)[1] == "export":
                    put("export", word)
            continue
        elif before[1] in ("const", "let", "var", ",") and after[1] == "=" and _is_arrow(tokens, close, i + 2):
            put("function", word)
        if after[1] == "(" and (member or word not in _NO_CALL and before[1] not in ("function", "new")) and not _is_method(tokens, close, i):
            put("call", word)
    return out


def _closings(tokens: list[tuple[str, str, int]]) -> dict[int, int]:
    """Place behind the parenthesis that closes each opening one."""
    out, opened = {}, []
    for j, (kind, word, _) in enumerate(tokens):
        if kind == "sign" and word == "(":
            opened.append(j)
        elif kind == "sign" and word == ")" and opened:
            out[opened.pop()] = j + 1
    return out


def _is_arrow(tokens: list[tuple[str, str, int]], close: dict[int, int], i: int) -> bool:
    i += i < len(tokens) and tokens[i][1] == "async"
    i = close.get(i, i + (i < len(tokens) and tokens[i][0] == "name"))
    return i < len(tokens) and tokens[i][1] == "=>"


def _is_method(tokens: list[tuple[str, str, int]], close: dict[int, int], i: int) -> bool:
    """Whether the name opens a method: behind a brace, semicolon or modifier, with a body behind its parameters."""
    before = tokens[i - 1][1] if i else ""
    j = close.get(i + 1, len(tokens))
    return before in ("{", "}", ";", "async", "static", "get", "set", "*", ",", "") and j < len(tokens) and tokens[j][1] == "{"


_FACTS = "file_id bigint, repo_id string, ref string, file_path string, language string, seq int, fact string, owner string, name string, line int"


def facts(files: DataFrame) -> DataFrame:
    """Facts of every Python and JavaScript file, the file itself first (fact ``file``)."""
    names = [x.split()[0] for x in _FACTS.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for *key, text in zip(*(c.to_pylist() for c in b.columns)):
                found = python_facts(text or "") if key[-1] == "python" else javascript_facts(text or "")
                if found is not None:
                    rows += [(*key, i, *f) for i, f in enumerate([("file", None, key[3], 0), *found])]
            for i in range(0, len(rows), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 50_000]), types)], names)

    language = paths.language(F.col("file_path"))
    slim = files.where(F.col("file_path").isNotNull() & language.isin("python", "javascript"))
    found = slim.select(F.col("file_id").cast("bigint").alias("file_id"), "repo_id", "ref", "file_path", language.alias("language"), "raw_content").mapInArrow(run, _FACTS)
    # Of several crawls of a path the last counts: their ids are few rows, so the facts of older ones are sifted by a join on the path.
    last = files.groupBy("repo_id", "ref", "file_path").agg(F.max(F.col("file_id").cast("bigint")).alias("last"))
    key = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("repo_id", "ref", "file_path")]
    return found.alias("a").join(last.alias("b"), [*key, F.col("a.file_id") == F.col("b.last")], "left_semi")


def _class_id() -> F.Column:
    return F.concat_ws("::", "file_path", "name")


def nodes(found: DataFrame) -> DataFrame:
    """(repo_id, ref, node_id, type, name, file, language, line, functions, classes, methods, exports): files and classes with what they hold, in the order of the text."""
    names = lambda fact: F.transform(F.array_sort(F.collect_list(F.when(F.col("fact") == fact, F.struct("seq", "name")))), lambda s: s["name"]).alias(fact)
    files = found.groupBy("repo_id", "ref", "file_path").agg(F.first("language").alias("language"), *[names(x) for x in ("function", "class", "export")])
    none = F.array().cast("array<string>")
    of_file = files.select("repo_id", "ref", F.col("file_path").alias("node_id"), F.lit("file").alias("type"), F.lit(None).cast("string").alias("name"), F.col("file_path").alias("file"), "language", F.lit(None).cast("int").alias("line"), F.col("function").alias("functions"), F.col("class").alias("classes"), none.alias("methods"), F.col("export").alias("exports"))
    # A class and the methods whose class it is meet under the class's name; of two classes of a name the last line counts, and both give their methods.
    owned = found.where(F.col("fact").isin("class", "method")).withColumn("of", F.when(F.col("fact") == "class", F.col("name")).otherwise(F.col("owner")))
    classes = owned.groupBy("repo_id", "ref", "file_path", "of").agg(F.first("language").alias("language"), F.max(F.when(F.col("fact") == "class", F.col("line"))).alias("line"), names("method")).where(F.col("line").isNotNull() & (F.col("language") == "python"))
    of_class = classes.select("repo_id", "ref", F.concat_ws("::", "file_path", "of").alias("node_id"), F.lit("class").alias("type"), F.col("of").alias("name"), F.col("file_path").alias("file"), "language", "line", none.alias("functions"), none.alias("classes"), F.col("method").alias("methods"), none.alias("exports"))
    return of_file.unionByName(of_class)


def edges(found: DataFrame) -> DataFrame:
    """(repo_id, ref, seq, source, target, type): bases, then imports, then calls of a file, each in the order of the text."""
    kind = F.create_map(*[F.lit(x) for x in ("base", "INHERITS_FROM", "import", "IMPORTS", "call", "CALLS")])
    order = F.create_map(*[F.lit(x) for x in ("base", 0, "import", 1, "call", 2)])
    rows = found.where(F.col("fact").isin("base", "import", "call"))
    source = F.when(F.col("owner").isNotNull(), F.concat_ws("::", "file_path", "owner")).otherwise(F.col("file_path"))
    return rows.select("repo_id", "ref", (order[F.col("fact")].cast("bigint") * F.lit(1 << 32) + F.col("seq")).alias("seq"), source.alias("source"), F.col("name").alias("target"), kind[F.col("fact")].alias("type"))


def call_counts(found_edges: DataFrame, most: int = 15) -> DataFrame:
    """(repo_id, source, n_imports, n_calls, rank): sources by their calls, the first ``most`` of a repository. Counts come before the ranks, so a hot repository ranks sources and not calls."""
    per = found_edges.groupBy("repo_id", "source").agg(F.count_distinct(F.when(F.col("type") == "IMPORTS", F.col("target"))).alias("n_imports"), F.count_if(F.col("type") == "CALLS").alias("n_calls"))
    order = Window.partitionBy("repo_id").orderBy(F.desc("n_calls"), "source")
    return per.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= most)


def grouped(found_edges: DataFrame) -> DataFrame:
    """(repo_id, source, type, n, targets): the distinct targets of every source, sorted."""
    return found_edges.groupBy("repo_id", "source", "type").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("target")), ", ").alias("targets"))


def handler_edges(endpoints: DataFrame, found: DataFrame) -> DataFrame:
    """(file_id, path, handler, node_id, targets): the node that holds an endpoint's handler, and the names its edges lead to; without a node both are null and empty."""
    holds = found.where(F.col("fact").isin("function", "method")).select("file_id", F.col("name").alias("handler"), F.when(F.col("owner").isNotNull(), F.concat_ws("::", "file_path", "owner")).otherwise(F.col("file_path")).alias("node_id"), "repo_id", "ref").distinct()
    out = edges(found).groupBy("repo_id", "ref", F.col("source").alias("node_id")).agg(F.array_sort(F.collect_set("target")).alias("targets"))
    at = endpoints.select("file_id", "path", "handler").join(holds, ["file_id", "handler"], "left")
    reached = at.join(out.withColumnRenamed("repo_id", "r").withColumnRenamed("ref", "f").withColumnRenamed("node_id", "n"), F.col("repo_id").eqNullSafe(F.col("r")) & F.col("ref").eqNullSafe(F.col("f")) & (F.col("node_id") == F.col("n")), "left")
    return reached.select("file_id", "path", "handler", "node_id", F.coalesce("targets", F.array().cast("array<string>")).alias("targets"))

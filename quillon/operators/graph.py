"""Graphs of files: imports, collapse, neighbourhoods, impact, order and traces.

An edge table has (repo_id, seq, source, target, type). Every step is a join on (repo_id, node), so repositories are worked on side by side and a hot one
spreads over its nodes. Loops are over depth, on the driver; each level holds distinct nodes and excludes those already seen, and is
materialised in the shared checkpoint folder so that plans do not grow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import paths
from quillon.session import cut_lineage

def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), group)


def _listed(names: Column) -> Column:
    """The names of a comma-separated list, without aliases, brackets and blanks."""
    parts = F.transform(F.split(F.regexp_replace(names, r"[()\\\s]+", " "), ","), lambda x: F.trim(F.regexp_replace(x, r"\s+as\s+.*$", "")))
    return F.filter(parts, lambda x: x != "")


def imports(text: Column, language: Column) -> Column:
    """Column: what a file imports, as its language writes it, a list of full names; statements are read whole, also over several lines and with several names."""
    pairs = r"(?m)^[ \t]*from[ \t]+([\w.]+)[ \t]+import[ \t]+(\([^)]*\)|[^\n#;]+)"
    python = F.concat(
        F.flatten(F.transform(_all(text, r"(?m)^[ \t]*import[ \t]+([\w., \t]+)"), _listed)),
        F.flatten(F.zip_with(_all(text, pairs), _all(text, pairs, 2), lambda m, ns: F.transform(_listed(ns), lambda n: F.concat(m, F.when(m.endswith("."), "").otherwise("."), n)))),
    )
    script = _all(text, r"""(?m)(?:\brequire\(\s*|\bfrom\s+|^\s*import\s+)['"]([^'"\n]+)['"]""")
    go = F.concat(_all(text, r'(?m)^\s*import\s+(?:[\w.]+\s+)?"([^"\n]+)"'), F.flatten(F.transform(_all(text, r"(?ms)^\s*import\s*\((.*?)\)"), lambda x: _all(x, r'"([^"\n]+)"'))))
    none = F.array().cast("array<string>")
    return (
        F.when(language == "python", python).when(language.isin("javascript", "typescript"), script).when(language.isin("java", "kotlin", "scala", "csharp"), _all(text, r"(?m)^\s*(?:import|using)\s+(?:static\s+)?([\w.]+)"))
        .when(language == "go", go).when(language == "rust", _all(text, r"(?m)^\s*(?:pub\s+)?use\s+([\w:]+)")).when(language == "cpp", _all(text, r'(?m)^\s*#\s*include\s+["<]([^">\n]+)[">]'))
        .when(language == "php", F.concat(_all(text, r"""\b(?:require|include)(?:_once)?[\s(]+['"]([^'"\n]+)['"]"""), _all(text, r"(?m)^\s*use\s+([\w\\]+)"))).when(language == "ruby", _all(text, r"""(?m)^\s*require(?:_relative)?\s+['"]([^'"\n]+)['"]""")).otherwise(none)
    )


def _module(name: Column, language: Column) -> Column:
    """Column: the last part of a full name, which may be a file's name: of a path its stem, else what follows the last separator."""
    return F.when(language.isin("javascript", "typescript", "go", "cpp", "php", "ruby") & ~name.contains("\\"), paths.stem(name)).otherwise(F.regexp_extract(name, r"(\w*)$", 1))


def import_edges(files: DataFrame) -> DataFrame:
    """(repo_id, seq, source, target, type): imports of every file; a name whose last part is a file of the repository resolves to its path, any other stays as written."""
    # Names are taken before the shuffle, so texts never move; of several crawls of a path the last counts.
    language = paths.language(F.col("file_path"))
    slim = files.where("raw_content is not null and file_path is not null").select("repo_id", "file_path", "file_id", language.alias("language"), imports(F.col("raw_content"), language).alias("names"))
    base = slim.groupBy("repo_id", "file_path").agg(F.max_by("names", "file_id").alias("names"), F.first("language").alias("language"))
    named = base.select("repo_id", F.col("file_path").alias("source"), "language", F.posexplode("names").alias("seq", "name")).withColumn("module", _module(F.col("name"), F.col("language")))
    known = base.groupBy("repo_id", paths.stem(F.col("file_path")).alias("module")).agg(F.min("file_path").alias("path"))
    return named.join(known, ["repo_id", "module"], "left").select("repo_id", F.col("seq").cast("bigint").alias("seq"), "source", F.coalesce("path", "name").alias("target"), F.lit("IMPORTS").alias("type"))


def file_nodes(files: DataFrame) -> DataFrame:
    return files.where("file_path is not null").select("repo_id", F.col("file_path").alias("node_id")).distinct()


def collapse(edges: DataFrame) -> DataFrame:
    """One edge per (source, target); of parallel edges the last type counts. Collapsed edges stay as they are."""
    if "seq" not in edges.columns:
        return edges
    return edges.groupBy("repo_id", "source", "target").agg(F.max_by("type", F.struct("seq", "type")).alias("type"))


def with_known_source(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.join(nodes.select("repo_id", F.col("node_id").alias("source")), ["repo_id", "source"], "left_semi")


def degrees(edges: DataFrame) -> DataFrame:
    """(repo_id, node, in_degree, out_degree, level): low without dependants, medium up to three, else high."""
    e = collapse(edges)
    both = e.select("repo_id", F.col("source").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(e.select("repo_id", F.col("target").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    agg = both.groupBy("repo_id", "node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    return agg.withColumn("level", F.when(F.col("in_degree") == 0, "low").when(F.col("in_degree") <= 3, "medium").otherwise("high"))


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int = 2, inclusive: bool = False, reverse: bool = False) -> DataFrame:
    """(repo_id, seed, node, depth) of the nodes reached from each seed, seeds at depth 0.

    Without ``inclusive`` the last level is not entered, so ``max_depth=2`` gives distances 0 and 1. Seeds that have no edge are kept.
    """
    e = collapse(edges).select("repo_id", F.col("target" if reverse else "source").alias("node"), F.col("source" if reverse else "target").alias("next"))
    seen = seeds.select("repo_id", F.col("seed"), F.col("seed").alias("node"), F.lit(0).alias("depth")).distinct()
    front = seen
    for depth in range(1, max_depth + (1 if inclusive else 0)):
        new = front.join(e, ["repo_id", "node"]).select("repo_id", "seed", F.col("next").alias("node")).distinct()
        front = cut_lineage(new.join(seen, ["repo_id", "seed", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def blast_radius(edges: DataFrame, seeds: DataFrame, max_depth: int = 2) -> DataFrame:
    """(repo_id, seed, n_upstream, n_downstream, n_affected): followed both ways; the seed itself counts as affected. The edges are stored once for both ways."""
    stored = cut_lineage(collapse(edges))
    up = reach(stored, seeds, max_depth).withColumn("way", F.lit("up"))
    down = reach(stored, seeds, max_depth, reverse=True).withColumn("way", F.lit("down"))
    both = up.unionByName(down)
    per = both.groupBy("repo_id", "seed", "node").agg(F.bool_or((F.col("way") == "up") & (F.col("depth") > 0)).alias("u"), F.bool_or((F.col("way") == "down") & (F.col("depth") > 0)).alias("d"))
    return per.groupBy("repo_id", "seed").agg(F.count_if("u").alias("n_upstream"), F.count_if("d").alias("n_downstream"), F.count("*").alias("n_affected"))


def impact_score(radius: Column, file_count: int = 100) -> Column:
    return F.sqrt(F.least(radius / file_count, F.lit(1.0)))


def suitability(radius: Column, most: int = 100) -> Column:
    return F.when(radius <= 0, 100.0).otherwise(100 - F.least(radius, F.lit(most)) / most * 100)


def neighbours(edges: DataFrame, locus: DataFrame) -> DataFrame:
    """(repo_id, node): the locus and everything one edge away, either way."""
    e = collapse(edges)
    at = locus.select("repo_id", F.col("seed").alias("x"))
    out = e.join(at, (e.repo_id == at.repo_id) & (e.source == at.x), "left_semi").select("repo_id", F.col("target").alias("node"))
    into = e.join(at, (e.repo_id == at.repo_id) & (e.target == at.x), "left_semi").select("repo_id", F.col("source").alias("node"))
    return locus.select("repo_id", F.col("seed").alias("node")).unionByName(out).unionByName(into).distinct()


def topological_levels(edges: DataFrame, nodes: DataFrame, most: int = 1_000) -> DataFrame:
    """(repo_id, node, level) by peeling nodes without incoming edges; members of cycles, and what only they lead to, get none.

    The rounds are as many as the longest path; ``most`` guards against endless loops, not against large inputs.
    """
    e = cut_lineage(collapse(edges).where("source <> target").join(nodes.select("repo_id", F.col("node").alias("source")), ["repo_id", "source"], "left_semi").join(nodes.select("repo_id", F.col("node").alias("target")), ["repo_id", "target"], "left_semi"))
    rest = cut_lineage(nodes.select("repo_id", "node").distinct())
    out = None
    for level in range(most):
        blocked = e.select("repo_id", F.col("target").alias("node")).distinct()
        free = cut_lineage(rest.join(blocked, ["repo_id", "node"], "left_anti").withColumn("level", F.lit(level)))
        if free.isEmpty():
            break
        out = free if out is None else out.unionByName(free)
        gone = free.select("repo_id", "node")
        rest = cut_lineage(rest.join(gone, ["repo_id", "node"], "left_anti"))
        e = cut_lineage(e.join(gone.withColumnRenamed("node", "source"), ["repo_id", "source"], "left_anti"))
    return out if out is not None else rest.withColumn("level", F.lit(0)).limit(0)


def trace(edges: DataFrame, start: DataFrame, max_depth: int = 10) -> DataFrame:
    """Steps of every walk from the starts, in depth-first order: (repo_id, start, step, source, target, depth, is_recursive).

    A walk does not enter a node twice: a step back to its own path is followed by one row that says so. Successors follow in the order of seq.
    The number of walks can grow exponentially with the depth, as the result itself does.
    """
    allowed = edges.where(F.col("type").isin("CALLS", "INHERITS_FROM", "IMPLEMENTS", "USES", "IMPORTS"))
    first = allowed.groupBy("repo_id", "source", "target").agg(F.max_by("type", "seq").alias("type"), F.min("seq").alias("seq"))
    order = Window.partitionBy("repo_id", "source").orderBy("seq", "target")
    e = cut_lineage(first.withColumn("ord", F.row_number().over(order)).select("repo_id", F.col("source").alias("at"), F.col("target").alias("to"), "ord"))
    front = start.select("repo_id", F.col("seed").alias("start"), F.col("seed").alias("at"), F.array("seed").alias("path"), F.array().cast("array<int>").alias("key"))
    steps = None
    for depth in range(1, max_depth + 1):
        out = front.join(e, ["repo_id", "at"]).withColumn("again", F.array_contains("path", F.col("to")))
        level = cut_lineage(out.select("repo_id", "start", "at", "to", F.array_append("key", F.col("ord")).alias("key"), "path", "again", F.lit(depth).alias("depth")))
        if level.isEmpty():
            break
        steps = level if steps is None else steps.unionByName(level)
        front = level.where("not again").select("repo_id", "start", F.col("to").alias("at"), F.array_append("path", F.col("to")).alias("path"), "key")
    if steps is None:
        return start.selectExpr("repo_id", "seed as start", "0L as step", "seed as source", "seed as target", "0 as depth", "false as is_recursive").limit(0)
    rows = steps.withColumn("is_recursive", F.explode(F.when((F.col("again")) & (F.col("depth") < max_depth), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    sequence = Window.partitionBy("repo_id", "start").orderBy("key", "is_recursive")
    return rows.select("repo_id", "start", F.row_number().over(sequence).cast("bigint").alias("step"), F.col("at").alias("source"), F.col("to").alias("target"), "depth", "is_recursive")


def trace_stats(steps: DataFrame) -> DataFrame:
    return steps.groupBy("repo_id", "start").agg(F.count("*").alias("n_steps"), F.max("depth").alias("max_depth"), F.countDistinct("target").alias("nodes_visited"), F.bool_or("is_recursive").alias("has_recursion"))


def layout(steps: DataFrame) -> DataFrame:
    """(repo_id, start, node, x, y): nodes by least depth, spread within their layer by name."""
    least = steps.where("not is_recursive").groupBy("repo_id", "start", F.col("target").alias("node")).agg(F.min("depth").alias("layer"))
    at = F.row_number().over(Window.partitionBy("repo_id", "start", "layer").orderBy("node")) - 1
    return least.select("repo_id", "start", "node", (50 + 200 * at).alias("x"), (50 + 80 * F.col("layer")).alias("y"))


def difference(base: DataFrame, head: DataFrame, columns: list[str]) -> DataFrame:
    """(columns..., side): added in head or removed from base, as sets."""
    b, h = base.select(*columns).distinct(), head.select(*columns).distinct()
    return h.subtract(b).withColumn("side", F.lit("added")).unionByName(b.subtract(h).withColumn("side", F.lit("removed")))

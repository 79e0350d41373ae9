"""Queries on import graphs and changed lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import diffs, graph
from quillon.session import cut_lineage
from quillon.sources.tables import table


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.import_edges(table(spark, d, "source_files"))


def _stored(spark: SparkSession, d: str) -> DataFrame:
    """The edges, materialised for queries that read them several times, so that texts are read once."""
    return cut_lineage(_edges(spark, d))


def _seeds(spark: SparkSession, d: str) -> DataFrame:
    """The first path of every repository."""
    return table(spark, d, "source_files").groupBy("repo_id").agg(F.min("file_path").alias("seed"))


def linked_seeds(edges: DataFrame) -> DataFrame:
    """Every file that imports something, as a seed of its repository."""
    return edges.select("repo_id", F.col("source").alias("seed")).distinct()


def import_graph(spark: SparkSession, d: str) -> DataFrame:
    """Collapsed edges."""
    return graph.collapse(_edges(spark, d))


def known_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges whose source is a file of the crawl; sources that only stand in edges are left out."""
    nodes = graph.file_nodes(table(spark, d, "source_files").where("file_path not like '%test%'"))
    return graph.with_known_source(graph.collapse(_edges(spark, d)), nodes).select("repo_id", "source", "target")


def file_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges whose target is a file, too."""
    nodes = graph.file_nodes(table(spark, d, "source_files"))
    return graph.collapse(_edges(spark, d)).join(nodes.withColumnRenamed("node_id", "target"), ["repo_id", "target"], "left_semi").select("repo_id", "source", "target")


def node_degrees(spark: SparkSession, d: str) -> DataFrame:
    """A40, A39, G15."""
    return graph.degrees(_edges(spark, d))


def reachable(spark: SparkSession, d: str) -> DataFrame:
    """Nodes within two edges of the first file."""
    return graph.reach(_edges(spark, d), _seeds(spark, d), 2, inclusive=True).withColumn("depth", F.col("depth").cast("bigint"))


def blast_radius(spark: SparkSession, d: str) -> DataFrame:
    """Both ways, with impact and suitability."""
    r = graph.blast_radius(_edges(spark, d), _seeds(spark, d))
    n = F.col("n_affected")
    return r.withColumn("impact", F.round(graph.impact_score(n), 6)).withColumn("suitability", F.round(graph.suitability(n), 4))


def one_hop(spark: SparkSession, d: str) -> DataFrame:
    """J12."""
    return graph.neighbours(_edges(spark, d), _seeds(spark, d))


def reachable_linked(spark: SparkSession, d: str) -> DataFrame:
    """Nodes within two edges of every file with imports."""
    e = _stored(spark, d)
    return graph.reach(e, linked_seeds(e), 2, inclusive=True).withColumn("depth", F.col("depth").cast("bigint"))


def blast_radius_linked(spark: SparkSession, d: str) -> DataFrame:
    """G5, G6, G7, U3 for every file with imports."""
    e = _stored(spark, d)
    r = graph.blast_radius(e, linked_seeds(e))
    n = F.col("n_affected")
    return r.withColumn("impact", F.round(graph.impact_score(n), 6)).withColumn("suitability", F.round(graph.suitability(n), 4))


def one_hop_linked(spark: SparkSession, d: str) -> DataFrame:
    """J12 around every file with imports."""
    e = _stored(spark, d)
    return graph.neighbours(e, linked_seeds(e))


def learning_order(spark: SparkSession, d: str) -> DataFrame:
    """Levels of the files with imports and their neighbourhood; cycles get none."""
    e = _stored(spark, d)
    return graph.topological_levels(e, graph.neighbours(e, linked_seeds(e)))


def call_traces(spark: SparkSession, d: str) -> DataFrame:
    """Walks from every file with imports, to the operator's own depth."""
    e = _stored(spark, d)
    return graph.trace(e, linked_seeds(e))


def trace_stats(spark: SparkSession, d: str) -> DataFrame:
    """G9."""
    return graph.trace_stats(call_traces(spark, d))


def trace_layout(spark: SparkSession, d: str) -> DataFrame:
    """G10."""
    return graph.layout(call_traces(spark, d))


def graph_difference(spark: SparkSession, d: str) -> DataFrame:
    """Edges of the files crawled in the second half of a repository's crawls against those of the first half; each repository has one ref here, so the halves stand for base and head."""
    f = table(spark, d, "source_files").where("raw_content is not null and file_path is not null and repo_id is not null").withColumn("us", F.unix_micros("crawled_at"))
    cut = f.groupBy("repo_id").agg(((F.min("us") + F.max("us")) / 2).alias("cut"))
    both = f.join(cut, "repo_id")
    base, head = (graph.collapse(graph.import_edges(both.where(half))) for half in ("us <= cut", "us > cut"))
    return graph.difference(base, head, ["repo_id", "source", "target"])


def learning_levels(spark: SparkSession, d: str) -> DataFrame:
    """The files and modules that nothing imports, and those that only they import, for SQL to compare."""
    e = _stored(spark, d)
    return graph.topological_levels(e, graph.neighbours(e, linked_seeds(e))).where("level <= 1").withColumn("level", F.col("level").cast("bigint"))


def _hunks(spark: SparkSession, d: str) -> DataFrame:
    """A change per file, at a place and of a length given by its id; the tables hold no diffs."""
    f = table(spark, d, "source_files").where("file_path is not null")
    status = F.when(F.col("file_id") % 11 == 0, "added").when(F.col("file_id") % 13 == 0, "deleted").otherwise("modified")
    return f.select("file_id", (F.col("file_id") % 50 + 1).alias("start"), (F.col("file_id") % 7).alias("len"), status.alias("status"))


def _spans(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").where("start_line is not null and end_line is not null").select("file_id", F.col("chunk_id").alias("span_id"), "start_line", "end_line")


def touched_spans(spark: SparkSession, d: str) -> DataFrame:
    """Interval overlap."""
    return diffs.touched_spans(_hunks(spark, d), _spans(spark, d), ["file_id"])


def routed_changes(spark: SparkSession, d: str) -> DataFrame:
    """J4."""
    return diffs.routed(_hunks(spark, d), _spans(spark, d), ["file_id"]).distinct()


def changed_unknown_files(spark: SparkSession, d: str) -> DataFrame:
    """J5."""
    return diffs.unknown_files(_hunks(spark, d), _spans(spark, d), ["file_id"])


QUERIES = {f.__name__: f for f in (import_graph, known_edges, file_edges, learning_levels, node_degrees, reachable, blast_radius, one_hop, reachable_linked, blast_radius_linked, one_hop_linked, learning_order, call_traces, trace_stats, trace_layout, graph_difference, touched_spans, routed_changes, changed_unknown_files)}

_STEM = r"regexp_replace(regexp_extract({}, '([^/]*)$', 1), '^(.+)\.[^.]+$', '\1')"
#: The import forms that stand in the tables, by extension: (extensions, pattern, written name, last part).
_FORMS = [
    ("py|pyi|pyx", r"(?m)^import (\w+)", "{1}", "{1}"), ("py|pyi|pyx", r"(?m)^from (\S+) import (\w+)", "{1} || CASE WHEN ends_with({1}, '.') THEN '' ELSE '.' END || {2}", "{2}"), ("js|mjs|cjs|jsx|gs", r'require\("([^"\n]+)"\)', "{1}", None), ("js|mjs|cjs|jsx|gs|ts|tsx", r'(?m)^import .*from "([^"\n]+)"', "{1}", None),
    ("java", r"(?m)^import ([a-z.]+\.)(\w+);", "{1} || {2}", "{2}"), ("go", r'(?m)^\t"([^"\n]+)"', "{1}", None), ("rs", r"(?m)^use (\w+::)(\w+);", "{1} || {2}", "{2}"), ("cpp|cxx|cc|c|h|hpp", r'(?m)^#include "([^"\n]+)"', "{1}", None), ("php", r'require_once "([^"\n]+)"', "{1}", None), ("rb", r'(?m)^require_relative "([^"\n]+)"', "{1}", None),
]


def _form(ext: str, pattern: str, name: str, last: str | None, tag: str) -> str:
    groups = 2 if "{2}" in name else 1
    p = pattern.replace("'", "''")
    cols = ", ".join(f"unnest(regexp_extract_all(text, '{p}', {g})) AS g{g}" for g in range(1, groups + 1))
    put = lambda x: x.replace("{1}", "g1").replace("{2}", "g2")
    return f"SELECT repo_id, source, {put(name)} AS name, {put(last) if last else _STEM.format('g1')} AS module FROM (SELECT repo_id, file_path AS source, {cols} FROM b{tag} WHERE regexp_matches(lower(file_path), '\\.({ext})$'))"


def _edge_sql(where: str = "true", tag: str = "") -> str:
    """Common table expressions that end in e: the edges of the last crawl of every path, of the files that ``where`` admits."""
    forms = " UNION ALL ".join(_form(*f, tag) for f in _FORMS)
    return f"""b{tag} AS (SELECT repo_id, file_path, arg_max(raw_content, file_id) AS text FROM source_files WHERE raw_content IS NOT NULL AND file_path IS NOT NULL AND {where} GROUP BY 1, 2), n{tag} AS ({forms}),
    k{tag} AS (SELECT repo_id, {_STEM.format('file_path')} AS module, min(file_path) AS path FROM b{tag} GROUP BY 1, 2),
    e{tag} AS (SELECT DISTINCT repo_id, source, coalesce(path, name) AS target, 'IMPORTS' AS type FROM n{tag} LEFT JOIN k{tag} USING (repo_id, module))"""


_HALF = "epoch_us(crawled_at) {} (SELECT cut FROM c WHERE c.repo_id = source_files.repo_id)"
_E = f"{_edge_sql()}, s AS (SELECT repo_id, min(file_path) AS seed FROM source_files GROUP BY 1)"
_UP = "u AS (SELECT s.repo_id, seed, target AS node FROM s JOIN e ON s.repo_id IS NOT DISTINCT FROM e.repo_id AND e.source = s.seed WHERE target <> seed), dn AS (SELECT s.repo_id, seed, source AS node FROM s JOIN e ON s.repo_id = e.repo_id AND e.target = s.seed WHERE source <> seed)"
_H = "h AS (SELECT file_id, file_id % 50 + 1 AS start, file_id % 7 AS len, CASE WHEN file_id % 11 = 0 THEN 'added' WHEN file_id % 13 = 0 THEN 'deleted' ELSE 'modified' END AS status FROM source_files WHERE file_path IS NOT NULL), sp AS (SELECT file_id, chunk_id AS span_id, start_line, end_line FROM chunks WHERE start_line IS NOT NULL AND end_line IS NOT NULL)"
_OVER = "SELECT DISTINCT file_id, span_id{x} FROM h JOIN sp USING (file_id) WHERE len > 0 AND start <= end_line AND start_line <= start + len - 1"
ORACLES = {
    "import_graph": f"WITH {_E} SELECT repo_id, source, target, type FROM e",
    "known_edges": f"WITH {_E} SELECT DISTINCT repo_id, source, target FROM e WHERE NOT contains(source, 'test')",
    "file_edges": f"WITH {_E} SELECT DISTINCT e.repo_id, e.source, e.target FROM e JOIN source_files f ON f.repo_id = e.repo_id AND f.file_path = e.target",
    "learning_levels": f"WITH {_E}, g AS (SELECT repo_id, source, target FROM e WHERE source <> target), v AS (SELECT repo_id, source AS node FROM e UNION SELECT repo_id, target FROM e), z AS (SELECT v.repo_id, node FROM v ANTI JOIN g ON g.repo_id = v.repo_id AND g.target = node), o AS (SELECT g.repo_id, g.target AS node FROM g LEFT JOIN z ON z.repo_id = g.repo_id AND z.node = g.source GROUP BY 1, 2 HAVING bool_and(z.node IS NOT NULL)) SELECT repo_id, node, CAST(0 AS BIGINT) AS level FROM z UNION ALL SELECT repo_id, node, CAST(1 AS BIGINT) FROM o",
    "node_degrees": f"WITH {_E}, x AS (SELECT repo_id, source AS node, 0 AS i, 1 AS o FROM e UNION ALL SELECT repo_id, target, 1, 0 FROM e), a AS (SELECT repo_id, node, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree FROM x GROUP BY 1, 2) SELECT *, CASE WHEN in_degree = 0 THEN 'low' WHEN in_degree <= 3 THEN 'medium' ELSE 'high' END AS level FROM a",
    "reachable": f"WITH RECURSIVE {_E}, r AS (SELECT repo_id, seed, seed AS node, CAST(0 AS BIGINT) AS depth FROM s UNION SELECT r.repo_id, seed, target, depth + 1 FROM r JOIN e ON r.repo_id = e.repo_id AND e.source = r.node WHERE depth < 2) SELECT repo_id, seed, node, min(depth) AS depth FROM r GROUP BY 1, 2, 3",
    "blast_radius": f"WITH {_E}, {_UP}, a AS (SELECT repo_id, seed, seed AS node, false AS u, false AS d FROM s UNION ALL SELECT *, true, false FROM u UNION ALL SELECT *, false, true FROM dn), g AS (SELECT repo_id, seed, node, bool_or(u) AS u, bool_or(d) AS d FROM a GROUP BY 1, 2, 3), t AS (SELECT repo_id, seed, CAST(count_if(u) AS BIGINT) AS n_upstream, CAST(count_if(d) AS BIGINT) AS n_downstream, count(*) AS n_affected FROM g GROUP BY 1, 2) SELECT *, round(sqrt(least(n_affected / 100, 1)), 6) AS impact, round(100 - least(n_affected, 100) / 100 * 100, 4) AS suitability FROM t",
    "one_hop": f"WITH {_E}, {_UP} SELECT repo_id, seed AS node FROM s UNION SELECT repo_id, node FROM u UNION SELECT repo_id, node FROM dn",
    "graph_difference": f"WITH c AS (SELECT repo_id, (min(epoch_us(crawled_at)) + max(epoch_us(crawled_at))) / 2 AS cut FROM source_files WHERE raw_content IS NOT NULL AND file_path IS NOT NULL GROUP BY 1), {_edge_sql(_HALF.format('>'))}, {_edge_sql(_HALF.format('<='), '0')}, h AS (SELECT repo_id, source, target FROM e), f AS (SELECT repo_id, source, target FROM e0) SELECT *, 'added' AS side FROM (SELECT * FROM h EXCEPT SELECT * FROM f) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM f EXCEPT SELECT * FROM h)",
    "touched_spans": f"WITH {_H} {_OVER.format(x='')}",
    "routed_changes": f"WITH {_H} SELECT DISTINCT file_id, span_id, status AS change FROM h JOIN sp USING (file_id) WHERE status <> 'modified' UNION ALL ({_OVER.format(x=", 'modified' AS change")} AND status = 'modified')",
    "changed_unknown_files": f"WITH {_H} SELECT DISTINCT file_id FROM h WHERE file_id NOT IN (SELECT file_id FROM sp)",
}
#: The same statements, asked from every file with imports.
ORACLES |= {f"{k}_linked": ORACLES[k].replace("s AS (SELECT repo_id, min(file_path) AS seed FROM source_files GROUP BY 1)", "s AS (SELECT DISTINCT repo_id, source AS seed FROM e)") for k in ("reachable", "blast_radius", "one_hop")}

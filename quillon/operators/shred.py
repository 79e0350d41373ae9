"""Adjacency-table shredding of nested JSON records.

Every payload becomes a set of *nodes* (record_id, node, parent, label, ordinal, kind, scalar): one row per
object, array or scalar, numbered in preorder within its record. Entity tables (files, chunks, endpoints,
dependencies, services) are then plain relational work on that table: object nodes are joined with their
scalar children, which are pivoted into columns, and with their ancestors for the parent link.

Defined results:
* a null, empty or unreadable payload gives no node (a truncated document is unreadable as a whole);
* a payload that is a JSON string holding a document is unwrapped, as is a document below a wrapper member
  (``{"cortex": {...}}``);
* a collection may be an array of objects, a single object, or an object keyed by the child's key;
  null members of a collection give no child; a child whose key is missing gives no row in a table of links;
* NaN and Infinity are read as the literals they are, numbers keep their text, of repeated member names the last counts;
* duplicate children within a record are kept in the entity tables (each has its own node) and are
  distinct in :func:`links`.

Scale: a record is shredded where it is read, with no shuffle, and every object's row repeats what is known of its parent. The pivot and the join with the owner are on (record_id, node), so a hot
repository spreads by record and node; only files and services are joined with their document by record alone. Nothing is broadcast but what Spark finds small, and nothing is collected. Pivoted objects are materialised
once in the shared checkpoint folder.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.session import cut_lineage

NODE_SCHEMA = (
    "record_id bigint, node int, parent int, label string, ordinal int, kind string, scalar string, depth int, "
    "p_label string, p_kind string, grand int, g_label string, p_keyed boolean, p_named boolean"
)

#: Member names that hold collections of entities -> (kind, key member, member that tells a single object).
COLLECTIONS = {
    "files": ("file", "file_path"),
    "text_chunks": ("chunk", "chunk_id"),
    "api_endpoints": ("endpoint", "path"),
    "services": ("service", "name"),
}


def _document(payload: str | None):
    """The parsed payload, with strings that hold JSON unwrapped; None if unreadable."""
    value = payload
    while isinstance(value, str):  # every layer is shorter than the one around it
        try:
            value = json.loads(value)
        except (ValueError, RecursionError):
            return None
    return value if isinstance(value, (dict, list)) else None


def _scalar(value) -> bool:
    return value is not None and not isinstance(value, (dict, list))


def shred_value(document) -> list[tuple]:
    """Preorder nodes of one document: (node, parent, label, ordinal, kind, scalar, depth, p_label, p_kind, grand, g_label, p_keyed, p_named).

    The last six repeat what is known of the parent, on objects and arrays alone, so that looking one step up needs no join: its label, kind and parent, and whether it states the
    key of the collection that it is named like, and a name.
    """
    out: list[tuple] = []
    states: dict[int, tuple[bool, bool]] = {}
    nothing = (None,) * 6
    stack = [(document, None, "$", 0, 0)]
    while stack:
        value, parent, label, ordinal, depth = stack.pop()
        node = len(out)
        if isinstance(value, (dict, list)):
            up = out[parent] if parent is not None else None
            above = (up[2], up[4], up[1], up[7], *states.get(parent, (False, False))) if up else nothing
            kind = "object" if isinstance(value, dict) else "array"
            if kind == "object":
                states[node] = label in COLLECTIONS and _scalar(value.get(COLLECTIONS[label][1])), _scalar(value.get("name"))
            out.append((node, parent, label, ordinal, kind, None, depth, *above))
            members = list(value.items()) if kind == "object" else [("[]", v) for v in value]
            stack.extend((v, node, k, i, depth + 1) for i, (k, v) in reversed(list(enumerate(members))))
        elif value is None:
            out.append((node, parent, label, ordinal, "null", None, depth, *nothing))
        elif isinstance(value, str):
            out.append((node, parent, label, ordinal, "string", value.encode("utf-8", "replace").decode(), depth, *nothing))
        elif isinstance(value, bool):
            out.append((node, parent, label, ordinal, "boolean", "true" if value else "false", depth, *nothing))
        else:
            out.append((node, parent, label, ordinal, "number", repr(value), depth, *nothing))
    return out


def shred(records: DataFrame, id_col: str = "record_id", payload_col: str = "payload", labels: list[str] | None = None) -> DataFrame:
    """Adjacency table of all nodes of all readable payloads; with ``labels``, of scalars only those so named."""
    wanted = None if labels is None else frozenset(labels)
    names = [x.split()[0] for x in NODE_SCHEMA.split(", ")]
    types = [{"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}[x.split()[1]] for x in NODE_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for rid, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                document = _document(payload)
                if document is not None:
                    rows += [(rid, *n) for n in shred_value(document) if wanted is None or n[4] in ("object", "array") or n[2] in wanted]
                if len(rows) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    slim = records.select(F.col(id_col).cast("bigint").alias("record_id"), F.col(payload_col).alias("payload"))
    return slim.where(F.col("payload").isNotNull()).mapInArrow(run, NODE_SCHEMA)


def stored(records: DataFrame) -> DataFrame:
    """The whole adjacency table, materialised so that payloads are parsed once for several entity tables."""
    return cut_lineage(shred(records))


KEY_LABELS = ["file_path", "chunk_id", "path", "name", "repo_id", "dependency_type"]


def objects(nodes: DataFrame, labels: list[str]) -> DataFrame:
    """Every object joined with its scalar children, pivoted: (record_id, node, label, parent, p_label, ..., c_<label>...).

    An object's row and the rows of its children meet under the object's number, so the join and the pivot are one aggregation, combined map-side (the rows of an object leave the
    shredder together). Of repeated labels the largest value counts; JSON keeps one.
    """
    own = F.col("kind") == "object"
    rows = nodes.where(own | (F.col("scalar").isNotNull() & F.col("label").isin(labels)))
    up = ["label", "parent", "p_label", (F.col("p_kind") == "array").alias("in_array"), "grand", (F.col("g_label") == "dependencies").alias("in_dependencies"), "p_keyed", "p_named"]
    slim = rows.select("record_id", F.when(own, F.col("node")).otherwise(F.col("parent")).alias("node"), own.alias("own"), F.when(own, F.struct(*up)).alias("at"), F.when(~own, F.col("label")).alias("l"), "scalar")
    pivot = [F.max(F.when(F.col("l") == x, F.col("scalar"))).alias(f"c_{x}") for x in labels]
    # Scalars of a member that is no object's (an array's "[]") have no row of their own kind and fall out here.
    return slim.groupBy("record_id", "node").agg(F.max("at").alias("at"), F.bool_or("own").alias("own"), *pivot).where("own").select("record_id", "node", "at.*", *[f"c_{x}" for x in labels])


def entity_nodes(pivoted: DataFrame) -> DataFrame:
    """Objects that are entities: (record_id, node, kind, map_key, owner, category, c_...).

    ``owner`` is the object that owns the collection; ``map_key`` is the member name where the collection is keyed by its children; ``category`` is the member of
    ``dependencies``. An object named like a collection that states a child's key is that single child, else a map of children.
    """
    own_key = F.lit(None).cast("string")
    for name, (_, key) in COLLECTIONS.items():
        own_key = F.when(F.col("label") == name, F.col(f"c_{key}")).otherwise(own_key)
    inner = pivoted.withColumn("own_key", own_key)
    in_array, deep, known = F.coalesce("in_array", F.lit(False)), F.coalesce("in_dependencies", F.lit(False)), list(COLLECTIONS)
    label, plabel = F.col("label"), F.coalesce("p_label", F.lit(""))
    kind_of = F.create_map(*[x for k, v in COLLECTIONS.items() for x in (F.lit(k), F.lit(v[0]))])
    listed = in_array & plabel.isin(known)
    mapped = ~in_array & plabel.isin(known) & ~F.coalesce("p_keyed", F.lit(False))
    single = ~in_array & ~mapped & label.isin(known) & F.col("own_key").isNotNull()
    dep_flat = in_array & (plabel == "dependencies")
    dep_listed = in_array & deep
    dep_single = ~in_array & (plabel == "dependencies") & F.col("c_name").isNotNull()
    dep_keyed = ~in_array & deep & ~F.coalesce("p_named", F.lit(False))
    kind = (
        F.when(listed | mapped, kind_of[plabel])
        .when(single, kind_of[label])
        .when(dep_flat | dep_listed | dep_single | dep_keyed, F.lit("dependency"))
    )
    return inner.select(
        "record_id",
        "node",
        kind.alias("kind"),
        F.when(mapped, label).when(listed | single, F.lit(None)).when(dep_keyed, label).alias("map_key"),
        F.when(single, F.col("parent")).otherwise(F.col("grand")).alias("owner"),
        F.when(dep_listed | dep_keyed, plabel).when(dep_single, label).alias("category"),
        *[c for c in pivoted.columns if c.startswith("c_")],
    ).where(F.col("kind").isNotNull())


def entities(nodes: DataFrame, labels: list[str] = KEY_LABELS) -> DataFrame:
    """Every entity with its pivoted scalars, its key and its parent's key.

    Columns: record_id, node, kind, owner, parent_key, child_key, and c_<label> for each label asked for. The pivoted objects are materialised, as three steps read them.
    """
    labels = list(dict.fromkeys([*KEY_LABELS, *labels]))
    pivoted = cut_lineage(objects(nodes, labels))
    found = entity_nodes(pivoted)
    own = F.when(F.col("kind") == "file", F.col("c_file_path")).when(F.col("kind") == "chunk", F.col("c_chunk_id"))
    own = own.when(F.col("kind") == "endpoint", F.col("c_path")).otherwise(F.col("c_name"))
    found = found.withColumn("child_key", F.coalesce(own, F.col("map_key")))
    # A file kept in a map has its path as the map's key, so chunks take the file's child_key.
    files = found.where(F.col("kind") == "file").select("record_id", F.col("node").alias("owner"), F.col("child_key").alias("parent_key"))
    # The document is the object that states repo_id nearest the root. It is the parent of files and services alone, which are few in a record beside the chunks.
    documents = pivoted.where(F.col("c_repo_id").isNotNull()).groupBy("record_id").agg(F.min_by("c_repo_id", "node").alias("parent_key"))
    inside = found.where(F.col("kind").isin("chunk", "endpoint")).join(files, ["record_id", "owner"], "left")
    top = found.where(F.col("kind").isin("file", "service")).join(documents, "record_id", "left")
    deps = found.where(F.col("kind") == "dependency").withColumn("parent_key", F.coalesce("category", "c_dependency_type"))
    return inside.unionByName(top).unionByName(deps)


def links(nodes: DataFrame) -> DataFrame:
    """Distinct (record_id, kind, parent_key, child_key); children without a key give none."""
    return (
        entities(nodes)
        .where(F.col("child_key").isNotNull())
        .select("record_id", "kind", "parent_key", "child_key")
        .distinct()
    )


#: Scalar members of every kind's table, and members that are arrays of scalars. Left out are members that hold entities of their own, and a service's environment, which is a map.
TABLE_COLUMNS = {
    "file": ["file_path", "file_size_kb", "detected_language", "raw_content", "ast_summary"],
    "chunk": ["chunk_id", "chunk_text", "token_count", "chunk_type", "name", "language", "start_line", "end_line"],
    "endpoint": ["path", "handler_function_name", "framework", "start_line", "end_line"],
    "dependency": ["name", "version", "dependency_type", "ecosystem", "license", "deprecated"],
    "service": ["name", "version", "service_type"],
}
TABLE_LISTS = {"file": ["code_smells", "framework_hints"], "endpoint": ["methods"], "service": ["ports"]}
_CASTS = {"file_size_kb": "double", "token_count": "int", "start_line": "int", "end_line": "int", "deprecated": "boolean"}


def entity_table(nodes: DataFrame, kind: str) -> DataFrame:
    """Flat table of one kind with its parent link; numbers kept as text are cast, unreadable ones are null."""
    cols = TABLE_COLUMNS[kind]
    rows = entities(nodes, cols).where(F.col("kind") == kind)
    typed = [F.expr(f"try_cast(c_{c} as {_CASTS[c]})").alias(c) if c in _CASTS else F.col(f"c_{c}").alias(c) for c in cols]
    base = rows.select("record_id", "node", F.col("owner").alias("parent_node"), "parent_key", "child_key", *typed)
    wanted = TABLE_LISTS.get(kind, [])
    return base.join(_member_lists(nodes, wanted), ["record_id", "node"], "left") if wanted else base


def _member_lists(nodes: DataFrame, labels: list[str]) -> DataFrame:
    """Values of members that are a scalar or an array of scalars: (record_id, node, <label> array...)."""
    filled = nodes.where(F.col("scalar").isNotNull())
    alone = filled.where(F.col("label").isin(labels)).select("record_id", F.col("parent").alias("node"), "label", "ordinal", "scalar")
    arrays = nodes.where(F.col("label").isin(labels) & (F.col("kind") == "array")).select("record_id", F.col("node").alias("parent"), F.col("parent").alias("node"), "label")
    listed = filled.where(F.col("label") == "[]").select("record_id", "parent", "ordinal", "scalar").join(arrays, ["record_id", "parent"]).select("record_id", "node", "label", "ordinal", "scalar")
    values = lambda x: F.transform(F.array_sort(F.collect_list(F.when(F.col("label") == x, F.struct("ordinal", "scalar")))), lambda s: s["scalar"])
    full = lambda x: F.when(F.count_if(F.col("label") == x) > 0, values(x)).alias(x)
    return alone.unionByName(listed).groupBy("record_id", "node").agg(*[full(x) for x in labels])

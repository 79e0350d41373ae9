"""Filling fixed-capacity containers with items (problem 8).

Method: hierarchical residual packing. Every partition packs its items best-fit (largest first) where they are, with no shuffle; containers that are nearly full are
emitted. The emptier ones become the items of a merge tree: neighbouring partitions meet, their containers are packed best-fit again, and so on, until one group is left or
merging no longer lowers the number of groups.

Defined results: an item above the capacity is split into full containers and a rest; no other item is split. Items of size 0 or null (null and
empty texts) fill nothing and get no container. Which items share a container depends on how the input is partitioned and ordered; sizes, capacities and the number of parts never do.
Repeated ids are separate items of the same name. A class with a null or non-positive capacity is left out; duplicate class names pack once per row.

Scale: a partition packs runs of at most GROUP_ITEMS items per class. What moves is only (container, size) of underfull containers, a few numbers each; members are joined to their last
container once, at the end. A group of the tree holds about GROUP_ITEMS containers, as the number of groups follows the counts. Every level is materialised in the shared checkpoint folder, so
a lost executor repeats one level only. The classes are sent to the workers after a check of their number.
"""

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.session import cut_lineage

GROUP_ITEMS = 20_000
FULL = 0.99
MAX_CLASSES = 1_000
#: A container's number is its partition's number above its place in the partition.
PLACES = 40


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: indexes of the items in each container. Ties go by index."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    free_of: dict[int, list[int]] = {}
    have = 0  # bit f is set if some container has f left
    bins: list[list[int]] = []
    for i in order:
        s = sizes[i]
        fitting = have >> s
        if fitting:
            f = s + ((fitting & -fitting).bit_length() - 1)
            b = free_of[f].pop()
            if not free_of[f]:
                have &= ~(1 << f)
            bins[b].append(i)
            f -= s
        else:
            b = len(bins)
            bins.append([i])
            f = capacity - s
        if f:
            free_of.setdefault(f, []).append(b)
            have |= 1 << f
    return bins


_LOCAL = "class int, bin bigint, used int, item bigint, segment int, size int, head boolean"


def local_bins(items: DataFrame, classes: list[tuple[str, int]], id_col: str, size_col: str) -> DataFrame:
    """One row per item (or part of one) and class: its container in its partition, how full that is, and whether the row is the container's first."""
    names = [x.split()[0] for x in _LOCAL.split(", ")]
    types = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, place = TaskContext.get().partitionId() << PLACES, 0

        def packed(held: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
            nonlocal place
            for c, (_, capacity) in enumerate(classes):
                rows, parts = [], []
                for item, size in held:
                    whole, left = divmod(size, capacity)
                    for k in range(whole):  # full by itself
                        rows.append((c, base + place, capacity, item, k, capacity, True))
                        place += 1
                    if left:
                        parts.append((item, whole, left))
                for chosen in best_fit([p[2] for p in parts], capacity):
                    used = sum(parts[i][2] for i in chosen)
                    rows += [(c, base + place, used, *parts[i], k == 0) for k, i in enumerate(chosen)]
                    place += 1
                for i in range(0, len(rows), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[i : i + 50_000]), types)], names)

        held: list[tuple[int, int]] = []
        for b in batches:
            for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held.append(row)
                if len(held) >= GROUP_ITEMS:
                    yield from packed(held)
                    held = []
        yield from packed(held)

    return items.select(F.col(id_col).cast("bigint").alias("item"), F.col(size_col).cast("bigint").alias("size")).where("size > 0").mapInArrow(run, _LOCAL)


_LEVEL = "class int, grp bigint, bin bigint, into bigint, used int"


def _merge(capacities: list[int]):
    """Pack the open containers of a group into each other; a container takes the number of its first member."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["used", "bin"], ascending=[False, True])
        used, bins = frame["used"].tolist(), frame["bin"].tolist()
        into, total = [0] * len(bins), [0] * len(bins)
        for chosen in best_fit(used, capacities[int(frame["class"].iloc[0])]):
            n = sum(used[i] for i in chosen)
            for i in chosen:
                into[i], total[i] = bins[chosen[0]], n
        return pd.DataFrame({"class": frame["class"].to_numpy(), "grp": frame["grp"].to_numpy(), "bin": bins, "into": into, "used": total})

    return run


def pack(items: DataFrame, classes: DataFrame, id_col: str = "doc_id", size_col: str = "n_tokens") -> DataFrame:
    """(class_name, capacity, container, item, segment, size): containers are numbered from 0 within each class."""
    rows = classes.where("capacity_tokens > 0").select("class_name", F.col("capacity_tokens").cast("int").alias("capacity")).limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} capacity classes")
    known = sorted((r.class_name or "", r.capacity) for r in rows)
    members = cut_lineage(local_bins(items, known, id_col, size_col))
    capacities = [c for _, c in known]
    limit = F.element_at(F.array(*[F.lit(int(FULL * c)) for c in capacities or [1]]), F.col("class") + 1)
    opened = members.where(F.col("head") & (F.col("used") < limit)).select("class", "bin", "used", F.shiftright("bin", PLACES).alias("grp"))
    moved = None  # containers that went into another, and where they are now
    groups = last = None
    while True:
        most, top = opened.groupBy("class").agg(F.count("*").alias("n"), F.max("grp").alias("g")).agg(F.max("n"), F.max("g")).first()
        if not most or last == 1:
            break
        before = top + 1 if groups is None else groups
        groups = max(1, min(before, -(-most // GROUP_ITEMS)))
        if last is not None and groups >= last:
            break
        # Neighbours meet: a group of this level is a run of groups of the level before.
        level = cut_lineage(opened.withColumn("grp", F.floor(F.col("grp") * groups / before).cast("bigint")).withColumn("bin", F.col("bin")).select("class", "grp", "bin", "used").groupBy("class", "grp").applyInPandas(_merge(capacities), _LEVEL))
        step = level.select("class", "bin", "into").where("bin <> into")
        if moved is None:
            moved = step
        else:
            then = step.select("class", F.col("bin").alias("into"), F.col("into").alias("to"))
            moved = moved.join(then, ["class", "into"], "left").select("class", "bin", F.coalesce("to", "into").alias("into")).unionByName(step)
        opened = level.where((F.col("bin") == F.col("into")) & (F.col("used") < limit)).select("class", "bin", "used", "grp")
        last = groups
    last_bin = F.col("bin")
    if moved is not None:
        members = members.join(moved, ["class", "bin"], "left")
        last_bin = F.coalesce("into", "bin")
    placed = members.select("class", "item", "segment", "size", last_bin.alias("bin"), F.shiftright(last_bin, PLACES).alias("block"))
    # Dense numbers without one big sort: containers of a partition in order, after the partitions before it.
    counts = placed.groupBy("class", "block").agg(F.countDistinct("bin").alias("n"))
    before_it = Window.partitionBy("class").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("class", "block", F.coalesce(F.sum("n").over(before_it), F.lit(0)).alias("offset"))
    numbered = placed.withColumn("at", F.dense_rank().over(Window.partitionBy("class", "block").orderBy("bin")) - 1).join(offsets, ["class", "block"])
    names = F.array(*[F.struct(F.lit(n).alias("class_name"), F.lit(c).alias("capacity")) for n, c in known or [("", 1)]])
    of = F.element_at(names, F.col("class") + 1)
    return numbered.select(of["class_name"].alias("class_name"), of["capacity"].alias("capacity"), (F.col("offset") + F.col("at")).alias("container"), "item", "segment", "size")


def fill(packed: DataFrame) -> DataFrame:
    """Containers, tokens, the fill and the fewest containers there could be, per class."""
    return packed.groupBy("class_name", "capacity").agg(
        F.countDistinct("container").alias("n_containers"), F.sum("size").alias("n_tokens"), F.count("*").alias("n_items"),
        F.ceil(F.sum("size") / F.first("capacity")).alias("least_containers"),
        F.round(F.sum("size") / (F.countDistinct("container") * F.first("capacity")), 6).alias("fill"),
    )

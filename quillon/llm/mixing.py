"""Mixing sources to target weights (problem 9).

Method: Efraimidis-Spirakis sampling. Every document gets an exponential key scaled by its quality weight; within a source the keys are sorted and the sizes
prefix-summed. A source's budget is met by whole epochs first, then by the documents with the smallest keys until the rest of the budget is used (the one
on the edge is taken if that comes nearer to it).

Defined results: budgets follow from the largest total at which every source that has documents reaches its share with at most max_repeats copies
(or from ``total_tokens``, where capped sources fall short and the report says so). A source without documents gives nothing. Source names are compared
without case, blanks and hyphens; documents of a null or blank source belong to no mix. Null and empty texts have size 0 and are never chosen. A null share or repeat count
counts as 0. Ties of keys are broken by id. Repeated ids are separate copies of the same document with the same key. Duplicate rows of a mix and source count once.

Scale: prefix sums are taken in two steps: sums per (source, bucket of keys), a window over the at most BUCKETS rows of a source, then a window
inside the one bucket where the budget ends. A source with a third of all rows thus spreads over BUCKETS keys. mix_targets is broadcast after a check of its number of rows.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.toxicity import source_name
from quillon.session import cut_lineage

BUCKETS = 4_096
MAX_TARGETS = 100_000
SEED = 17


def keyed(sized: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(source, doc_id, n_tokens, key, bucket) of the documents that can be chosen."""
    base = sized.where("n_tokens > 0").where(F.trim("source") != "").select(source_name(F.col("source")).alias("source"), "doc_id", "n_tokens")
    if weights is not None:
        w = weights.where("quality > 0").groupBy("doc_id").agg(F.avg("quality").alias("w"))
        base = base.join(w, "doc_id", "left")
    else:
        base = base.withColumn("w", F.lit(None).cast("double"))
    # u is uniform on (0, 1); -ln(u) / w is the key, and 1 - exp(-key) buckets it evenly for a weight of 1
    u = (F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    weight = F.coalesce(F.col("w"), F.lit(DEFAULT_QUALITY)) / F.lit(DEFAULT_QUALITY)
    key = -F.log(u) / weight
    return base.select("source", "doc_id", "n_tokens", key.alias("key"), F.least(F.floor((1 - F.exp(-key)) * BUCKETS), F.lit(BUCKETS - 1)).cast("int").alias("bucket"))


DEFAULT_QUALITY = 3.0


def budgets(targets: DataFrame, totals: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """(mix_name, source, share, repeats, available, budget, epochs, rest) per target row."""
    clean = targets.select("mix_name", source_name(F.col("source")).alias("source"), F.coalesce(F.col("target_share"), F.lit(0.0)).alias("share"), F.coalesce(F.col("max_repeats"), F.lit(0)).alias("repeats"))
    clean = clean.groupBy("mix_name", "source").agg(F.max("share").alias("share"), F.max("repeats").alias("repeats"))
    both = clean.join(totals, "source", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    reach = F.when((F.col("available") > 0) & (F.col("share") > 0) & (F.col("repeats") > 0), F.col("available") * F.col("repeats") / F.col("share"))
    total = F.min(reach).over(Window.partitionBy("mix_name")) if total_tokens is None else F.lit(float(total_tokens))
    budget = F.least(F.floor(F.coalesce(total, F.lit(0.0)) * F.col("share") + 1e-6), F.col("available") * F.col("repeats")).cast("bigint")
    out = both.withColumn("budget", budget)
    epochs = F.when(F.col("available") > 0, F.floor(F.col("budget") / F.col("available"))).otherwise(0).cast("int")
    return out.withColumn("epochs", epochs).withColumn("rest", F.col("budget") - F.col("epochs").cast("bigint") * F.col("available"))


def mix(sized: DataFrame, targets: DataFrame, weights: DataFrame | None = None, total_tokens: int | None = None) -> DataFrame:
    """(mix_name, source, doc_id, copy, n_tokens): the chosen documents, copies counted from 1."""
    n = targets.limit(MAX_TARGETS + 1).count()
    if n > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} target rows")
    docs = cut_lineage(keyed(sized, weights))
    sums = docs.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("n"))
    order = Window.partitionBy("source").orderBy("bucket")
    sums = sums.withColumn("upto", F.sum("n").over(order)).withColumn("below", F.col("upto") - F.col("n"))
    totals = docs.groupBy("source").agg(F.sum("n_tokens").alias("available"))
    plan = F.broadcast(budgets(targets, totals, total_tokens).where("budget > 0").select("mix_name", "source", "epochs", "rest"))
    chosen = docs.join(plan, "source")
    whole = chosen.where("epochs > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("epochs"))))
    whole = whole.select("mix_name", "source", "doc_id", "copy", "n_tokens")
    # Buckets wholly inside the rest are taken; the bucket where it ends is sorted and prefix-summed.
    marks = sums.join(plan, "source").where("rest > 0 and below < rest").select("mix_name", "source", "bucket", "below", "upto", "rest", "epochs")
    part = docs.join(marks, ["source", "bucket"])
    inside = part.where("upto <= rest").select("mix_name", "source", "doc_id", (F.col("epochs") + 1).alias("copy"), "n_tokens")
    edge_order = Window.partitionBy("mix_name", "source", "bucket").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    edge = part.where("upto > rest").withColumn("sum", F.sum("n_tokens").over(edge_order))
    # the document on the edge is taken if that comes nearer to the budget than leaving it
    edge = edge.where("below + sum <= rest or (below + sum - n_tokens < rest and below + sum - rest <= rest - (below + sum - n_tokens))")
    edge = edge.select("mix_name", "source", "doc_id", (F.col("epochs") + 1).alias("copy"), "n_tokens")
    return whole.unionByName(inside).unionByName(edge)


def report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Target and actual share of tokens per mix and source, with documents, copies and the most copies of one document."""
    per = mixed.groupBy("mix_name", "source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_copies"), F.countDistinct("doc_id").alias("n_docs"), F.max("copy").alias("most_copies"))
    want = targets.select("mix_name", source_name(F.col("source")).alias("source"), "target_share").groupBy("mix_name", "source").agg(F.max("target_share").alias("target_share"))
    both = want.join(per, ["mix_name", "source"], "left").fillna(0, ["tokens", "n_copies", "n_docs", "most_copies"])
    total = F.sum("tokens").over(Window.partitionBy("mix_name"))
    return both.withColumn("actual_share", F.round(F.when(total > 0, F.col("tokens") / total).otherwise(0.0), 6))

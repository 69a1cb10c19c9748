"""Mixing sources to target weights with DataFrame functions only: hash-threshold histograms.

Every document has a 40-bit hash of its id and text. Sizes are summed by source
and the hash's first 12 bits; a running sum over a source's buckets finds the
bucket in which its budget ends. Only that bucket is refined by the next 12 bits,
and its boundary again by the last 16. What results is one threshold for each
source, so documents are chosen by a comparison and never sorted. Rows with the
very hash at which a budget ends (as a rule one, more where rows repeat) are
counted by kind, and as many of a kind are taken as bring the sum nearest. A
target above the source's size first takes every document whole, as often as it
fits; the threshold then deals out the rest, so thresholds of growing budgets are
nested.

Defined cases: null texts have size 0; the null source is a source of its own;
sources of size 0 have target 0; rows that share a doc_id are parted by their
texts, rows that repeat both are taken by number; empty tables give empty
results. ``mix`` ignores further columns, ``mixed_documents`` keeps them, whatever
their names. Sources are one row each in the tables of targets, which pass
through one task: tens of millions are meant to fit there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelode.llm.common import stored, words_of

LEVELS = ((28, 12), (16, 12), (0, 16))  # of each level: bits below it, its own bits


def hash_of(key: Column, text: Column) -> Column:
    """40 bits that depend on id and text alone."""
    both = F.concat_ws("|", F.coalesce(key.cast("string"), F.lit("")), F.coalesce(text.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(both), 1, 10), 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", F.size(words_of(F.col("text"))).cast("long").alias("size"), hash_of(F.col("doc_id"), F.col("text")).alias("h"))


def targets(totals: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most_times: int = 2) -> DataFrame:
    """totals: source, source_size, one row a source. Adds ``target``: the source's part of share x all sizes by weight, none above most_times its size.

    With sources in the order of cap over weight, each running level is what a
    unit of weight gets once all before it are capped; the highest is the level
    at which nothing more is reshared.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    weighed = totals.withColumn("weight", F.get(kinds, F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))))
    every = W.partitionBy()
    before = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    left = lambda c: F.sum(c).over(every) - F.coalesce(F.sum(c).over(before), F.lit(0))
    level = (F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / left("weight")
    return (
        weighed.withColumn("cap", F.col("source_size") * most_times)
        .withColumn("level", level)
        .withColumn("target", F.least(F.col("cap").cast("double"), F.max("level").over(every) * F.col("weight")))
        .select("source", "source_size", "target")
    )


def _boundary(hist: DataFrame) -> DataFrame:
    """hist: source, rest, before, bits, b, s. The bucket of each source in which the running sum reaches rest."""
    upto = F.col("before") + F.sum("s").over(W.partitionBy("source").orderBy("b").rowsBetween(W.unboundedPreceding, 0))
    run = hist.withColumn("upto", upto)
    return run.where((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("s") < F.col("rest"))).select(
        "source", "rest", (F.col("upto") - F.col("s")).alias("before"), "bits", "b", F.col("upto")
    )


def thresholds(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """source, source_size, target, times, at, room: a document is taken times + (h < at) times, and of those with h = at as many more as come nearest to ``room``."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goals = goals.withColumn("times", whole).withColumn("rest", F.col("target") - F.col("times") * F.col("source_size"))
    edge = goals.select(F.col("source").alias("_s"), "rest", F.lit(0).cast("long").alias("before"), F.lit(0).cast("long").alias("bits"))
    for shift, own in LEVELS:
        buckets = 1 << own
        here = sizes.join(edge, sizes["source"].eqNullSafe(edge["_s"]) & (F.shiftright("h", shift + own) == edge["bits"]))
        hist = here.groupBy("source", "rest", "before", "bits", F.shiftright("h", shift).bitwiseAND(F.lit(buckets - 1)).alias("b")).agg(F.sum("size").alias("s"))
        edge = stored(_boundary(hist).select(F.col("source").alias("_s"), "rest", "before", (F.col("bits") * buckets + F.col("b")).alias("bits")), "mix-edge")
    ends = edge.select("_s", F.col("bits").alias("at"), (F.col("rest") - F.col("before")).alias("room"))
    return goals.join(ends, goals["source"].eqNullSafe(ends["_s"]), "left").select("source", "source_size", "target", "times", F.coalesce("at", F.lit(0).cast("long")).alias("at"), F.coalesce("room", F.lit(0.0)).alias("room"))


def _more(kinds: DataFrame, order: list) -> DataFrame:
    """kinds (cut columns, size, n) of rows at their source's boundary with ``more``: how many of the n are taken once more. Kinds at a boundary are few; their rows may be many."""
    w = W.partitionBy("cut_source").orderBy("size", *order).rowsBetween(W.unboundedPreceding, -1)
    left = F.col("cut_room") - F.coalesce(F.sum(F.col("n") * F.col("size")).over(w), F.lit(0))
    near = F.ceil(left / F.col("size") - 0.5)
    return kinds.withColumn("more", F.when(F.col("size") > 0, F.greatest(F.lit(0).cast("long"), F.least(near, F.col("n")))).otherwise(F.lit(0).cast("long")))


def _repeat(df: DataFrame, n: Column, at_once: int = 10_000) -> DataFrame:
    """Each row n times, with ``_k`` from 0; no array is longer than at_once."""
    runs = df.withColumn("_n", n).where("_n > 0").withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / at_once))))
    each = F.sequence(F.col("_run") * at_once, F.least(F.col("_run") * at_once + (at_once - 1), F.col("_n") - 1))
    return runs.withColumn("_k", F.explode(each)).drop("_n", "_run")


CUT = ("source", "source_size", "target", "times", "at", "room")


def _plan(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most_times: int = 2) -> tuple[DataFrame, DataFrame]:
    """(stored sizes, stored thresholds as ``cut_`` columns)."""
    sizes = stored(sized(docs), "mix-sizes")
    goals = stored(targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most_times), "mix-targets")
    return sizes, stored(thresholds(sizes, goals).select(*[F.col(c).alias(f"cut_{c}") for c in CUT]), "mix-cuts")


def mix(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source, source_size, target, times_taken, taken."""
    sizes, cuts = _plan(docs, **how)
    rows, kept = sizes.join(cuts, F.col("source").eqNullSafe(F.col("cut_source"))), ["doc_id", "size", *[f"cut_{c}" for c in CUT]]
    clear = rows.where("h <> cut_at").select(*kept, (F.col("cut_times") + F.when(F.col("h") < F.col("cut_at"), 1).otherwise(0)).alias("times"))
    kinds = _more(rows.where("h = cut_at").groupBy(*kept).agg(F.count("*").alias("n")), [F.col("doc_id").asc_nulls_first()])
    ends = _repeat(kinds, F.col("n")).select(*kept, (F.col("cut_times") + F.when(F.col("_k") < F.col("more"), 1).otherwise(0)).alias("times"))
    return clear.unionByName(ends).select(
        "doc_id", "size", *[F.col(f"cut_{c}").alias(c) for c in CUT[:3]], F.col("times").alias("times_taken"), (F.col("times") * F.col("size")).alias("taken")
    )


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs, with their columns, each as often as the mix takes it."""
    _, cuts = _plan(docs, **how)
    whole = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col("doc_id").alias("_id"), F.col("source").alias("_source"), hash_of(F.col("doc_id"), F.col("text")).alias("_h"),
        F.size(words_of(F.col("text"))).cast("long").alias("size"),
    )
    rows = whole.join(cuts, F.col("_source").eqNullSafe(F.col("cut_source")))
    times = F.col("cut_times") + F.when(F.col("_h") < F.col("cut_at"), 1).otherwise(0)
    clear = rows.where("_h <> cut_at").select("_doc", F.explode(F.array_repeat(F.lit(0), times.cast("int"))).alias("_k"))
    same = rows.where("_h = cut_at").groupBy(F.xxhash64(F.to_json("_doc")).alias("_key"), "_id", "size", *cuts.columns).agg(F.first("_doc").alias("_doc"), F.count("*").alias("n"))
    kinds = _more(same, [F.col("_id").asc_nulls_first(), F.col("_key")])
    return clear.select("_doc.*").union(_repeat(kinds, F.col("n") * F.col("cut_times") + F.col("more")).select("_doc.*"))

"""Joins, set operations and windows that keep or compare versions of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelode.schemas import ROW_KEY


def last_wins(rows: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """The last row of each key by ``order``, with partial aggregation before the shuffle."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r")).select(*key, "_r.*")


def first_wins(rows: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_r")).select(*key, "_r.*")


def with_blank_ids(rows: DataFrame, group: str, key: str, order: str) -> DataFrame:
    """rows whose blank keys are named BlankID_n by their order within the group."""
    blank = F.coalesce(F.trim(F.col(key)), F.lit("")) == ""
    n = F.sum(blank.cast("int")).over(W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn(key, F.when(blank, F.concat(F.lit("BlankID_"), n)).otherwise(F.col(key)))


def join_labels(features: DataFrame, labels: DataFrame, order: str = "seq") -> DataFrame:
    """features with their label: equal sample and seven-part row key, missing next_ parts being '', the last label of a key."""
    key = ["sample_id", *ROW_KEY]
    full = lambda df: df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ROW_KEY})
    return full(features).join(last_wins(full(labels).select(*key, "label", order), key, order).select(*key, "label"), key)


def keyed_diff(old: DataFrame, new: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """key, old_value, new_value, status: added, removed, changed or unchanged; null values are compared as values."""
    o = old.select(*key, F.col(value).alias("old_value"), F.lit(True).alias("_o"))
    n = new.select(*key, F.col(value).alias("new_value"), F.lit(True).alias("_n"))
    both = o.join(n, list(key), "full_outer")
    status = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(F.col("old_value").eqNullSafe(F.col("new_value")), "unchanged").otherwise("changed")
    return both.select(*key, "old_value", "new_value", status.alias("status"))


def diff_summary(diff: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """by, n_added, n_removed, n_changed, n_unchanged, code: the counts as ``<name>-A1-R2-C3``, ``<name>==`` where nothing differs."""
    n = lambda s: F.count_if(F.col("status") == s)
    out = diff.groupBy(*by).agg(n("added").alias("n_added"), n("removed").alias("n_removed"), n("changed").alias("n_changed"), n("unchanged").alias("n_unchanged"))
    same = (F.col("n_added") == 0) & (F.col("n_removed") == 0) & (F.col("n_changed") == 0)
    return out.withColumn("code", F.when(same, F.lit(f"{name}==")).otherwise(F.concat(F.lit(f"{name}-A"), "n_added", F.lit("-R"), "n_removed", F.lit("-C"), "n_changed")))


def set_diff(old: Column, new: Column) -> Column:
    """added, removed and common members of two arrays, sorted and without repeats."""
    sorted_ = lambda c: F.array_sort(F.array_distinct(c))
    return F.struct(sorted_(F.array_except(new, old)).alias("added"), sorted_(F.array_except(old, new)).alias("removed"), sorted_(F.array_intersect(old, new)).alias("common"))


def versions(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """rows with ``version`` 1 for the newest, 2 for the one before."""
    return rows.withColumn("version", F.row_number().over(W.partitionBy(*key).orderBy(*[F.desc(c) for c in order])))


def breaks(rows: DataFrame, group: str, order: Sequence[str], value: str) -> DataFrame:
    """rows with ``is_break`` where the value differs from the row before, and ``island``: the number of breaks so far."""
    w = W.partitionBy(group).orderBy(*order)
    changed = ~F.lag(value).over(w).eqNullSafe(F.col(value)) | (F.row_number().over(w) == 1)
    return rows.withColumn("is_break", changed).withColumn("island", F.sum(F.col("is_break").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))


def prefix_match(new: DataFrame, old: DataFrame, name: str = "name", length: int = 13) -> DataFrame:
    """new names with the first old name of the same prefix, how many there are, and a status."""
    prefix = F.substring(F.col(name), 1, length)
    found = old.groupBy(prefix.alias("_p")).agg(F.min(name).alias("old_name"), F.count("*").alias("n_matches"))
    out = new.select(name, prefix.alias("_p")).join(found, "_p", "left").withColumn("n_matches", F.coalesce("n_matches", F.lit(0)))
    status = F.when(F.col("n_matches") == 0, "older_not_found").when(F.col("n_matches") > 1, "several_older").otherwise("matched")
    return out.select(name, "old_name", "n_matches", status.alias("status"))


def first_existing(candidates: DataFrame, listing: DataFrame, key: str, path: str = "path", rank: str = "rank") -> DataFrame:
    """key, path: the candidate of lowest rank that is in the listing."""
    return candidates.join(listing.select(path).distinct(), path, "left_semi").groupBy(key).agg(F.min_by(path, rank).alias(path))


def orphans(rows: DataFrame, parents: DataFrame, on: str) -> DataFrame:
    """rows whose ``on`` no parent has."""
    return rows.join(parents.select(on).distinct(), on, "left_anti")


def resolve_fragments(links: DataFrame, elements: DataFrame) -> DataFrame:
    """doc, fragment, n, status: what a link's fragment names in its document: resolved, missing or ambiguous."""
    n = elements.groupBy("doc", F.col("id").alias("fragment")).agg(F.count("*").alias("n"))
    out = links.select("doc", "fragment").join(n, ["doc", "fragment"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("status", F.when(F.col("n") == 0, "missing").when(F.col("n") > 1, "ambiguous").otherwise("resolved"))

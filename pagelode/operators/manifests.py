"""Manifests: which samples take part, where their labels come from, and which of their files exist."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def _filled(name: str) -> Column:
    """The trimmed text of a column; null counts as ''."""
    return F.trim(F.coalesce(F.col(name).cast("string"), F.lit("")))


def selected(manifest: DataFrame, splits: Sequence[str] = (), ids: Sequence[str] = (), key: str = "sample_id") -> DataFrame:
    """Rows with a key (trimmed), of the splits and ids that are named; an empty list names all."""
    rows = manifest.withColumn(key, _filled(key)).where(F.col(key) != "")
    rows = rows.where(F.col("split").isin(*splits)) if splits else rows
    return rows.where(F.col(key).isin(*ids)) if ids else rows


def with_route(manifest: DataFrame) -> DataFrame:
    """manifest with ``route``: ``controls`` where no labels are named, ``manual`` for hand-made ones, else ``labelled``."""
    source, path = _filled("label_source"), _filled("label_path")
    return manifest.withColumn("route", F.when((source == "none") | (path == ""), "controls").when(source == "manual", "manual").otherwise("labelled"))


def eligible_labels(notes: DataFrame, mapping: DataFrame, page: str = "image_id", on: str = "source_label") -> DataFrame:
    """page, labels (sorted): the target labels of a page that may be trained on. Pages without one are left out."""
    usable = mapping.where((F.coalesce("use_for_training", F.lit("")) != "no") & (_filled("target_label") != "")).select(on, _filled("target_label").alias("target_label"))
    return notes.join(usable, on).groupBy(page).agg(F.array_sort(F.collect_set("target_label")).alias("labels"))


def payloads(entries: DataFrame, listing: DataFrame, ids: Sequence[str] = (), key: str = "source_id", path: str = "relative_path") -> DataFrame:
    """Entries that may be shared, name a path, and whose file is in the listing (a column of that name)."""
    rows = entries.where((_filled(path) != "") & (F.lower(_filled("local_only")) == "false"))
    rows = rows.where(F.col(key).isin(*ids)) if ids else rows
    return rows.join(listing.select(path), path, "left_semi")


def missing_files(manifest: DataFrame, listing: DataFrame, path: str) -> DataFrame:
    """Rows that name a path which is not in the listing."""
    return manifest.where(_filled(path) != "").join(listing.select(path), path, "left_anti")


def with_suffix_status(entries: DataFrame, suffixes: Sequence[str], path: str = "relative_path") -> DataFrame:
    """entries with ``suffix`` (lower case, without the dot) and ``status``: ready, or skipped with a ``reason``."""
    rows = entries.withColumn("suffix", F.lower(F.regexp_extract(_filled(path), r"\.([^./]*)$", 1)))
    known = F.col("suffix").isin(*suffixes) if suffixes else F.lit(True)
    return rows.withColumn("status", F.when(known, "ready").otherwise("skipped")).withColumn(
        "reason", F.when(known, "").when(F.col("suffix") == "", "no_suffix").otherwise(F.concat(F.lit("suffix_"), "suffix"))
    )

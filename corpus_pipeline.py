"""A training corpus in five stages: quality rules, language identification, near-duplicates, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
what a stage returns as Parquet to the shared scratch folder and rereads it as
the next one's documents. All but the last return the columns of documents. What
a stage stores for itself is removed when its rows are written, its documents
when the next stage's are.

Defined cases: null and empty texts have no words, so the first stage drops them;
null doc_id, lang and source are values like others (a document without an id
stays unless it is a copy); of equal documents and of near copies the smallest
id stays, of rows that repeat id and text one; very long texts are read whole;
further columns pass through whatever their names, but for the last stage, which
has columns of its own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagelode.llm import language_id, mixing, packing, quality_rules, simhash
from pagelode.llm.common import remove, scratch_folder, scratch_path, stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the current policy of the quality rules."""
    return quality_rules.keep_documents(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known."""
    return language_id.keep_known(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (sets of five-word shingles with a Jaccard likeness of 0.8 or more)."""
    return simhash.keep_first(docs, shingle=5)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their place in a sequence."""
    return packing.packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("language_id", language),
    ("simhash_dedup", deduplicate),
    ("source_mix", mix),
    ("best_fit_packing", pack),
]

#: SQL has no XXH64 fingerprints, kernels or tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        with scratch_folder(spark, f"stage-{name}"):
            docs = stored(stage(spark, docs, sf_dir), name, path)
        if before:
            remove(spark, before)
        before = path
    return docs

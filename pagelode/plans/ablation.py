"""From a manifest, features and labels to the comparison of five strategies on held-out rows.

Samples without labels are controls; labels join features by sample and row key;
a linear model is made of the train rows; the gate predicts all rows in one
projection, and every report starts from one count of label pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelode.operators import manifests, metrics, models, relations
from pagelode.plans import block_rules
from pagelode.schemas import BLOCK_LABELS, LEGACY_LABELS, ROW_KEY, feature_columns

#: Columns that are no features of the model.
RESERVED = (
    "sample_id", "source_path", *ROW_KEY, "text", "label", "notes", "manual_notes", "key", "split", "manifest_notes", "label_source", "label_confidence", "raw_label", "gold_label",
)
#: Names of the strategies in reports, and their label columns.
STRATEGIES = {"rules_only": "rule", "model_only": "model", "rules_model_naive": "naive", "rules_model_weighted": "weighted", "rules_model_gated": "gated"}


@dataclass
class Ablation:
    model: models.LinearModel
    predictions: DataFrame
    controls: DataFrame
    per_label: DataFrame
    summary: DataFrame
    conflicts: DataFrame
    samples: DataFrame


def labelled_rows(manifest: DataFrame, features: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(feature rows with split, raw_label and gold_label; controls with the number of their candidate rows). Labels that are neither current nor older names do not count."""
    routed = manifests.with_route(manifest)
    control = routed.where("route = 'controls'").select("sample_id", "split", "record_kind")
    sizes = features.groupBy("sample_id").agg(F.count("*").alias("candidate_count"))
    controls = control.join(sizes, "sample_id", "left").na.fill(0, ["candidate_count"])
    named = labels.withColumn("label", metrics.normalised(F.col("raw_label"), LEGACY_LABELS, BLOCK_LABELS)).where("label is not null")
    joined = relations.join_labels(features, named.select("sample_id", *ROW_KEY, F.struct("raw_label", "label").alias("label"), "seq"))
    mine = routed.where("route <> 'controls' and record_kind = 'block'").select("sample_id", "split")
    rows = joined.join(mine, "sample_id")
    return rows.select(*[c for c in rows.columns if c != "label"], F.col("label.raw_label").alias("raw_label"), F.col("label.label").alias("gold_label")), controls


def ablation(manifest: DataFrame, features: DataFrame, labels: DataFrame, preset: str = "conservative", model: models.LinearModel | None = None) -> Ablation:
    """manifest: sample_id, split, record_kind, label_source, label_path; features: sample_id, the row key, text and feature columns; labels: sample_id, the row key, raw_label, seq.

    A given (stored) model is used as it is; else one is made of the train rows.
    """
    rows, controls = labelled_rows(manifest, features, labels)
    model = model or models.build_model(rows.where("split = 'train'"), feature_columns(features, RESERVED), "gold_label")
    predicted = block_rules.predicted(models.with_model_scores(rows, model, BLOCK_LABELS), preset)
    held = predicted.where("split = 'heldout'")
    names = {strategy: f"{column}_label" for strategy, column in STRATEGIES.items()}
    pairs = F.inline(F.array(*[F.struct(F.lit(s).alias("strategy"), F.col(c).alias("pred")) for s, c in names.items()]))
    long = held.select("sample_id", F.col("gold_label").alias("gold"), pairs)
    pairs_of = metrics.confusion(long, by=["strategy"])
    counts = features.sparkSession.createDataFrame(pairs_of.collect(), pairs_of.schema)  # at most strategies x labels x labels rows
    samples = metrics.accuracy_by(long, "sample_id", by=["strategy"])
    against = metrics.against_baseline(samples, "rules_only", "sample_id", keep_baseline=True).select("strategy", F.col("n_improved").alias("improved_sample_count"), F.col("n_regressed").alias("regressed_sample_count"))
    micro = metrics.micro(counts, ["strategy"]).select("strategy", (F.col("tp") + F.col("fn")).alias("support"), "precision", "recall", "f1")
    summary = micro.join(metrics.targeted(counts, ["strategy"]), "strategy").join(against, "strategy")
    return Ablation(model, predicted, controls, metrics.per_label(counts, ["strategy"]), summary, metrics.conflicts(held, "rule_label", "model_label"), samples)

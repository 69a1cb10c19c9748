"""Evaluation of predictions: confusion, precision and recall, error counters, comparisons of strategies.

Every report starts from one small count by group, gold and predicted label, so
predictions are read and shuffled once and the rest works on label pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def normalised(raw: Column, legacy: dict[str, str], labels: Sequence[str]) -> Column:
    """The current name of a label: by the legacy map, or itself if it is current, else null."""
    table = F.create_map(*[F.lit(x) for pair in legacy.items() for x in pair])
    return F.coalesce(table[raw], F.when(raw.isin(*labels), raw))


def confusion(predictions: DataFrame, gold: str = "gold", pred: str = "pred", by: Sequence[str] = (), labels: Sequence[str] | None = None) -> DataFrame:
    """by, gold, pred, n; only pairs of ``labels`` where given."""
    rows = predictions if labels is None else predictions.where(F.col(gold).isin(*labels) & F.col(pred).isin(*labels))
    return rows.groupBy(*by, F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def per_label(counts: DataFrame, by: Sequence[str] = (), labels: Sequence[str] | None = None) -> DataFrame:
    """by, label, support, tp, fp, fn, precision, recall, f1 over the labels seen (gold or predicted), or over ``labels``, absent ones being 0."""
    roles = F.array(F.struct(F.col("gold").alias("label"), F.lit(True).alias("is_gold")), F.struct(F.col("pred").alias("label"), F.lit(False).alias("is_gold")))
    sides = counts.select(*by, "gold", "pred", "n", F.inline(roles)).where("label is not null")
    hit, n = F.col("gold").eqNullSafe(F.col("pred")), F.col("n")
    total = lambda c: F.sum(F.when(c, n).otherwise(0))
    out = sides.groupBy(*by, "label").agg(
        total(F.col("is_gold")).alias("support"), total(F.col("is_gold") & hit).alias("tp"), total(~F.col("is_gold") & ~hit).alias("fp"), total(F.col("is_gold") & ~hit).alias("fn")
    )
    if labels is not None:
        named = counts.sparkSession.createDataFrame([(x,) for x in labels], "label string")
        groups = counts.select(*by).distinct().crossJoin(named) if by else named  # report groups times a given label list
        out = groups.join(out, [*by, "label"], "left").na.fill(0, ["support", "tp", "fp", "fn"])
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return out.select(
        *by, "label", "support", "tp", "fp", "fn", F.bround(p, 4).alias("precision"), F.bround(r, 4).alias("recall"), F.bround(ratio(2 * p * r, p + r), 4).alias("f1")
    )


def with_support_flags(scores: DataFrame, low: int = 5) -> DataFrame:
    """per_label rows with zero_recall and low_support (under ``low`` but not 0)."""
    return scores.withColumn("zero_recall", (F.col("support") > 0) & (F.col("tp") == 0)).withColumn("low_support", (F.col("support") > 0) & (F.col("support") < low))


def micro(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, tp, fp, fn, precision, recall, f1 over all labels together; null labels count on neither side."""
    hit = F.col("gold").eqNullSafe(F.col("pred"))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n")).otherwise(0)), F.lit(0))
    out = counts.groupBy(*by).agg(total(hit).alias("tp"), total(~hit & F.col("pred").isNotNull()).alias("fp"), total(~hit & F.col("gold").isNotNull()).alias("fn"))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return out.select(*by, "tp", "fp", "fn", F.bround(p, 4).alias("precision"), F.bround(r, 4).alias("recall"), F.bround(ratio(2 * p * r, p + r), 4).alias("f1"))


def macro(counts: DataFrame, labels: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """by, macro_f1 (mean over ``labels``, those without support included) and accuracy."""
    mean = per_label(counts, by, labels).groupBy(*by).agg(F.bround(F.avg("f1"), 4).alias("macro_f1"))
    hits = F.sum(F.when(F.col("gold").eqNullSafe(F.col("pred")), F.col("n")).otherwise(0))
    right = counts.groupBy(*by).agg(F.bround(ratio(hits, F.sum("n")), 4).alias("accuracy"))
    return mean.join(right, list(by)) if by else mean.crossJoin(right)  # one row each


def targeted(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counters of errors that hurt most. Tables and form rows may stand for each other, and separators for page furniture."""
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n")).otherwise(0)), F.lit(0))
    g, p = F.coalesce("gold", F.lit("")), F.coalesce("pred", F.lit(""))
    tables = ("table_like", "form_row")
    return counts.groupBy(*by).agg(
        n((p == "heading") & (g != "heading")).alias("heading_false_positive_count"), n((g == "separator") & (p == "list_item")).alias("separator_as_list_count"),
        n(p.isin(*tables) & ~g.isin(*tables)).alias("false_table_promotion_count"), n((p == "footer_header_noise") & ~g.isin("footer_header_noise", "separator")).alias("false_noise_drop_count"),
        n((g == "footer_header_noise") & (p != "footer_header_noise")).alias("footer_header_false_negative_count"), n((p == "link_text") & (g != "link_text")).alias("link_text_false_positive_count"),
        n((g == "link_text") & (p != "link_text")).alias("link_text_false_negative_count"),
    )


def accuracy_by(predictions: DataFrame, sample: str, gold: str = "gold", pred: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    """by, sample, n, n_right, accuracy."""
    out = predictions.groupBy(*by, sample).agg(F.count("*").alias("n"), F.count_if(F.col(gold).eqNullSafe(F.col(pred))).alias("n_right"))
    return out.withColumn("accuracy", F.bround(F.col("n_right") / F.col("n"), 4))


def against_baseline(accuracies: DataFrame, baseline: str, sample: str, strategy: str = "strategy", keep_baseline: bool = False) -> DataFrame:
    """strategy, n_improved, n_regressed, mean_delta: by sample against one strategy, on rounded accuracies; samples that it lacks count as 0 there. ``keep_baseline`` gives its own row (zeros), too."""
    base = F.max(F.when(F.col(strategy) == baseline, F.col("accuracy"))).over(W.partitionBy(sample))  # a sample has one row a strategy
    rows = accuracies.withColumn("_d", F.bround(F.col("accuracy") - F.coalesce(base, F.lit(0.0)), 4))
    rows = rows if keep_baseline else rows.where(F.col(strategy) != baseline)
    return rows.groupBy(strategy).agg(F.count_if(F.col("_d") > 0).alias("n_improved"), F.count_if(F.col("_d") < 0).alias("n_regressed"), F.bround(F.avg("_d"), 4).alias("mean_delta"))


def conflicts(predictions: DataFrame, first: str, second: str) -> DataFrame:
    """The two labels and n."""
    return predictions.groupBy(first, second).agg(F.count("*").alias("n"))


def top_confusions(counts: DataFrame, most: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """The commonest wrong pairs of each group with their rank."""
    order = W.partitionBy(*by).orderBy(F.desc("n"), "gold", "pred")
    return counts.where("gold <> pred").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def examples(predictions: DataFrame, order: Sequence[str], most: int = 3, by: Sequence[str] = ()) -> DataFrame:
    """The first rows of each wrong pair; no more than ``most`` a task leave it."""
    rank = F.row_number().over(W.partitionBy(*by, "gold", "pred").orderBy(*order))
    return predictions.where("gold <> pred").withColumn("rank", rank).where(F.col("rank") <= most)


def strategies_long(predictions: DataFrame, key: Sequence[str], strategies: Sequence[str], gold: str = "gold") -> DataFrame:
    """key, gold, strategy, pred: one row for each strategy's label column ``<strategy>_label``; rows are read once."""
    return predictions.select(*key, F.col(gold).alias("gold"), F.inline(F.array(*[F.struct(F.lit(s).alias("strategy"), F.col(f"{s}_label").alias("pred")) for s in strategies])))

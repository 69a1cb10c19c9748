"""Linear models of labelled vectors: normalisation, centroid weights, scores; and logistic regression."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelode.functions.text import sigmoid


def long_form(rows: DataFrame, key: str, label: str, values: str) -> DataFrame:
    """key, label, i, x of a vector column; missing values are 0."""
    return rows.select(key, label, F.posexplode(values).alias("i", "x")).withColumn("x", F.coalesce(F.col("x").cast("double"), F.lit(0.0)))


def normalisation(long: DataFrame) -> DataFrame:
    """i, mean, scale: population deviation, 1 where the variance is at most 1e-12."""
    return long.groupBy("i").agg(F.avg("x").alias("mean"), F.var_pop("x").alias("_v")).select("i", "mean", F.when(F.col("_v") > 1e-12, F.sqrt("_v")).otherwise(F.lit(1.0)).alias("scale"))


def centroid_weights(long: DataFrame, scales: DataFrame) -> DataFrame:
    """label, i, weight, bias: one label against the rest, from the means of both sides.

    One pass sums each label's normalised values; the rest of a label is the
    total less its own, so no row is copied for each label.
    """
    z = long.join(scales, "i").withColumn("z", (F.col("x") - F.col("mean")) / F.col("scale"))
    own = z.groupBy("label", "i").agg(F.sum("z").alias("s"), F.count("*").alias("n"))
    every = W.partitionBy("i")
    n_rest, s_rest = F.sum("n").over(every) - F.col("n"), F.sum("s").over(every) - F.col("s")
    pos, neg = F.col("s") / F.col("n"), F.when(n_rest > 0, s_rest / n_rest).otherwise(F.lit(0.0))
    sides = own.select("label", "i", pos.alias("pos"), neg.alias("neg"))
    weighed = sides.withColumn("weight", F.col("pos") - F.col("neg"))
    return weighed.withColumn("bias", -F.sum((F.col("pos") + F.col("neg")) / 2 * F.col("weight")).over(W.partitionBy("label"))).select("label", "i", "weight", "bias")


def linear_model(scales: DataFrame, weights: DataFrame, labels: Sequence | None = None) -> LinearModel:
    """The model of collected normalisation and weights: labels x features numbers."""
    rows = sorted(scales.collect(), key=lambda r: r["i"])
    held: dict = {}
    for r in weights.collect():
        held.setdefault(r["label"], {})[r["i"]] = (r["weight"], r["bias"])
    names = sorted(held)
    return LinearModel(
        [str(r["i"]) for r in rows], [r["mean"] for r in rows], [r["scale"] for r in rows], names, {x: held[x][rows[0]["i"]][1] for x in names}, {x: [held[x][r["i"]][0] for r in rows] for x in names}, {}
    )


def scores(rows: DataFrame, model: LinearModel, values: str) -> DataFrame:
    """rows with ``scores``: an array of (candidate, score) in one projection, without exploding features or joining weights."""
    scaled = rows.withColumn("_x", model.scaled(F.col(values)))
    return scaled.withColumn("scores", F.array(*[F.struct(F.lit(x).alias("candidate"), model.raw(F.col("_x"), x).alias("score")) for x in model.labels])).drop("_x")


def best(scored: DataFrame) -> DataFrame:
    """scored with pred, score: the highest score to nine places, the smaller label of equals."""
    ranked = F.array_sort(F.transform("scores", lambda s: F.struct(-F.bround(s["score"], 9), s["candidate"].alias("pred"), s["score"].alias("score"))))
    return scored.withColumn("_b", F.get(ranked, F.lit(0))).select(*[c for c in scored.columns if c != "scores"], "_b.pred", "_b.score")


def thresholds(scored: DataFrame) -> DataFrame:
    """candidate, threshold: halfway between the lowest score of its own rows and the highest of others (0 if none)."""
    each = scored.select("label", F.inline("scores"))
    own = F.col("label") == F.col("candidate")
    low, high = F.min(F.when(own, F.col("score"))), F.coalesce(F.max(F.when(~own, F.col("score"))), F.lit(0.0))
    return each.groupBy("candidate").agg(((low + high) / 2).alias("threshold"))


def accepted(score: Column, confidence: Column, least_score: Column, least_confidence: Column) -> Column:
    return (score >= least_score) & (confidence >= least_confidence)


@dataclass(frozen=True)
class LinearModel:
    """A stored linear model: per label a bias and a weight for each normalised feature, and the least score and confidence to accept it."""

    features: list[str]
    mean: list[float]
    scale: list[float]
    labels: list[str]
    bias: dict[str, float]
    weights: dict[str, list[float]]
    least: dict[str, tuple[float, float]]
    about: dict = field(default_factory=dict)

    @staticmethod
    def of_json(text: str) -> LinearModel:
        m = json.loads(text)
        weights, least = m["weights"], m.get("thresholds", {})
        return LinearModel(
            m["features"], m["normalization"]["mean"], m["normalization"]["scale"], m["labels"], {k: v["bias"] for k, v in weights.items()}, {k: v["values"] for k, v in weights.items()},
            {k: (v["min_score"], v["min_confidence"]) for k, v in least.items()}, m.get("metadata", {}),
        )

    def to_json(self) -> str:
        least = {k: {"min_score": a, "min_confidence": b} for k, (a, b) in self.least.items()}
        weights = {k: {"bias": self.bias[k], "values": v} for k, v in self.weights.items()}
        out = {"version": 1, "task": "text_block_classifier", "model_type": "linear_v1", "labels": self.labels, "features": self.features, "normalization": {"mean": self.mean, "scale": self.scale}}
        return json.dumps(out | {"weights": weights, "thresholds": least, "metadata": self.about}, ensure_ascii=False, indent=2) + "\n"

    def scaled(self, values: Column) -> Column:
        """An array of values (in the order of the features), normalised; null is 0 before."""
        centred = F.zip_with(values, _doubles(self.mean), lambda x, m: F.coalesce(x.cast("double"), F.lit(0.0)) - m)
        return F.zip_with(centred, _doubles([s or 1.0 for s in self.scale]), lambda x, s: x / s)

    def raw(self, scaled: Column, label: str) -> Column:
        product = F.zip_with(scaled, _doubles(self.weights[label]), lambda x, w: x * w)
        return F.aggregate(product, F.lit(0.0), lambda a, x: a + x) + self.bias[label]


def _doubles(values: list[float]) -> Column:
    return F.from_json(F.lit(json.dumps(list(map(float, values)))), "array<double>")


def cells(df: DataFrame, names: Sequence[str]) -> Column:
    """An array of the named columns as numbers: null, '' and absent ones are 0, booleans 0 and 1; junk raises."""

    def number(name: str) -> Column:
        if name not in df.columns:
            return F.lit(0.0)
        kind, c = df.schema[name].dataType.typeName(), F.col(f"`{name}`")
        value = F.nullif(c, F.lit("")).cast("double") if kind == "string" else c.cast("int").cast("double") if kind == "boolean" else c.cast("double")
        return F.coalesce(value, F.lit(0.0))

    return F.array(*map(number, names))


def with_model_scores(df: DataFrame, model: LinearModel, labels: Sequence[str] = ()) -> DataFrame:
    """df with ``model_<label>`` (sigmoid scores, 0 for ``labels`` that the model lacks): one projection, no join."""
    scored = df.withColumn("_x", model.scaled(cells(df, model.features)))
    names = [*model.labels, *[x for x in labels if x not in model.labels]]
    return scored.select(*[F.col(f"`{c}`") for c in df.columns if c not in {f"model_{x}" for x in names}], *[(sigmoid(model.raw(F.col("_x"), x)) if x in model.weights else F.lit(0.0)).alias(f"model_{x}") for x in names])


def classified(df: DataFrame, model: LinearModel, values: Column | None = None) -> DataFrame:
    """df with pred, score, confidence, threshold, accepted: accepted labels go first, then the higher score, confidence, and the label's name."""
    entry = lambda x: F.struct(
        F.lit(x).alias("pred"), F.col("_raw")[x].alias("score"), sigmoid(F.col("_raw")[x]).alias("confidence"), F.lit(float(model.least.get(x, (0.0, 0.0))[0])).alias("threshold"),
        accepted(F.col("_raw")[x], sigmoid(F.col("_raw")[x]), F.lit(float(model.least.get(x, (0.0, 0.0))[0])), F.lit(float(model.least.get(x, (0.0, 0.0))[1]))).alias("accepted"),
    )
    scored = df.withColumn("_x", model.scaled(cells(df, model.features) if values is None else values)).withColumn("_raw", F.struct(*[model.raw(F.col("_x"), x).alias(x) for x in model.labels]))
    rank = lambda e: F.struct((~e["accepted"]).cast("int"), -e["score"], -e["confidence"], e["pred"])
    best = F.array_sort(F.array(*[F.struct(rank(entry(x)).alias("rank"), entry(x).alias("entry")) for x in model.labels]))
    return scored.withColumn("_best", F.get(best, F.lit(0))["entry"]).select(*[F.col(f"`{c}`") for c in df.columns], *[F.col("_best")[c].alias(c) for c in ("pred", "score", "confidence", "threshold", "accepted")])


def build_model(rows: DataFrame, names: Sequence[str], label: str = "label", about: dict | None = None, least_confidence: float = 0.5) -> LinearModel:
    """The centroid model of labelled rows: three aggregations over the rows (normalisation, centroids, thresholds), each of few numbers for a feature and label."""
    labelled = rows.where(F.col(label).isNotNull()).select(F.col(label).alias("_l"), cells(rows, names).alias("_x"))
    at = range(len(names))
    first = labelled.agg(*[f(F.col("_x")[i]).alias(f"{k}{i}") for i in at for k, f in (("m", F.avg), ("v", F.var_pop))]).first()
    if not names or first["m0"] is None:
        return LinearModel(list(names), [0.0] * len(names), [1.0] * len(names), [], {}, {}, {}, about or {})
    mean, scale = [first[f"m{i}"] for i in at], [first[f"v{i}"] ** 0.5 if first[f"v{i}"] > 1e-12 else 1.0 for i in at]
    plain = LinearModel(list(names), mean, scale, [], {}, {}, {})
    scaled = labelled.select("_l", plain.scaled(F.col("_x")).alias("_z"))
    sums = {r["_l"]: r for r in scaled.groupBy("_l").agg(F.count("*").alias("n"), *[F.sum(F.col("_z")[i]).alias(f"s{i}") for i in at]).collect()}  # one row a label
    n, total = sum(r["n"] for r in sums.values()), [sum(r[f"s{i}"] for r in sums.values()) for i in at]
    labels, bias, weights = sorted(sums), {}, {}
    for x in labels:
        own, rest = sums[x]["n"], n - sums[x]["n"]
        pos, neg = [sums[x][f"s{i}"] / own for i in at], [(total[i] - sums[x][f"s{i}"]) / rest if rest else 0.0 for i in at]
        weights[x] = [p - q for p, q in zip(pos, neg)]
        bias[x] = -sum(w * (p + q) / 2 for w, p, q in zip(weights[x], pos, neg))
    model = LinearModel(list(names), mean, scale, labels, bias, weights, {})
    own = lambda x: F.col("_l") == x
    ends = scaled.select("_l", *[model.raw(F.col("_z"), x).alias(f"r{k}") for k, x in enumerate(labels)]).agg(
        *[F.min(F.when(own(x), F.col(f"r{k}"))).alias(f"a{k}") for k, x in enumerate(labels)], *[F.max(F.when(~own(x), F.col(f"r{k}"))).alias(f"b{k}") for k, x in enumerate(labels)]
    ).first()
    least = {x: ((ends[f"a{k}"] + (ends[f"b{k}"] or 0.0)) / 2, least_confidence) for k, x in enumerate(labels)}
    told = {"sample_count": str(n), "label_counts": {x: str(sums[x]["n"]) for x in labels}}
    return LinearModel(list(names), mean, scale, labels, bias, weights, least, told | (about or {}))


def fit_logistic(rows: DataFrame, label: str = "label", values: str = "values", most_rounds: int = 100):
    """A pipeline of population-scaled features and balanced multinomial logistic regression with penalty 1/n; (model, function that predicts)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    sums = rows.select(F.posexplode(values).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).orderBy("i").collect()  # one row a feature
    counts = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count("*").alias("n")).collect()}
    n, names = sum(counts.values()), sorted(counts)
    mean = F.array(*[F.lit(float(r["m"])) for r in sums])
    scale = F.array(*[F.lit(float(r["s"]) or 1.0) for r in sums])
    index = F.create_map(*[F.lit(v) for i, x in enumerate(names) for v in (x, float(i))])
    weight = F.create_map(*[F.lit(v) for x in names for v in (x, n / (len(names) * counts[x]))])

    def prepared(df: DataFrame) -> DataFrame:
        scaled = F.zip_with(F.zip_with(F.col(values).cast("array<double>"), mean, lambda x, m: x - m), scale, lambda x, s: x / s)
        return df.withColumn("_x", array_to_vector(scaled)).withColumn("_y", index[F.col(label)]).withColumn("_w", weight[F.col(label)])

    model = LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="_w", family="multinomial", standardization=False, regParam=1.0 / n, elasticNetParam=0.0, maxIter=most_rounds).fit(prepared(rows))

    def predict(df: DataFrame) -> DataFrame:
        out = model.transform(prepared(df)).withColumn("pred", F.get(F.array(*map(F.lit, names)), F.col("prediction").cast("int")))
        return out.withColumn("confidence", F.array_max(vector_to_array("probability"))).drop("_x", "_y", "_w", "rawPrediction", "probability", "prediction")

    return model, predict

"""Training and scoring of vector classifiers with MLlib: balanced weights, linear and kernel machines, calibration, fusion."""

from __future__ import annotations

import math

import numpy as np
from pyspark import StorageLevel
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.crossval import fit_folds, margin_of
from millrace.operators.metrics import class_weights, stratified_split


def majority_group(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled vectors of the commonest setting and, among those, of its commonest length."""
    joined = features.filter("status = 'ok'").join(labels, "path")
    best = joined.groupBy("cfg_hash", F.size("vector").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first")).orderBy(F.desc("n"), "first").limit(1)
    return joined.withColumn("dim", F.size("vector")).join(F.broadcast(best.select("cfg_hash", "dim")), ["cfg_hash", "dim"])  # one row


def scale_columns(train: DataFrame, vector: str = "vector") -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation of each dimension, from one aggregate over the training rows."""
    size = train.select(F.size(vector)).first()[0]
    row = train.agg(*[f(F.get(vector, i).cast("double")).alias(f"{n}{i}") for i in range(size) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return np.array([row[f"m{i}"] for i in range(size)]), np.array([row[f"s{i}"] or 1.0 for i in range(size)])


def scaled(vector: Column, mean: np.ndarray, std: np.ndarray) -> Column:
    stats = F.array(*[F.struct(F.lit(float(m)).alias("m"), F.lit(float(s) if s > 0 else 1.0).alias("s")) for m, s in zip(mean, std, strict=True)])
    return F.zip_with(vector, stats, lambda x, p: (x.cast("double") - p["m"]) / p["s"])


def fourier_features(vector: Column, size: int, n: int = 128, gamma: float | None = None, seed: int = 1337) -> Column:
    """Random features whose products approach a Gaussian kernel; gamma is 1 / dimensions for scaled vectors."""
    rng = np.random.default_rng(seed)
    w = rng.normal(0, math.sqrt(2 * (gamma or 1 / size)), (n, size))
    b = rng.uniform(0, 2 * math.pi, n)
    rows = F.array(*[F.struct(F.array(*[F.lit(float(x)) for x in row]).alias("w"), F.lit(float(c)).alias("b")) for row, c in zip(w, b, strict=True)])
    dot = lambda p: F.aggregate(F.zip_with(vector, p["w"], lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    return F.transform(rows, lambda p: F.sqrt(F.lit(2.0 / n)) * F.cos(dot(p) + p["b"]))


def _fitted(estimator: Estimator, rows: DataFrame) -> Model:
    """The fitted model without its training summary, which holds the session: once anything in that session was observed
    (DataFrame.observe), a session cannot be serialized, and no task could score with a model that holds it."""
    model = estimator.fit(rows)
    model._java_obj.setSummary(rows.sparkSession._jvm.scala.Option.empty())
    return model


def train_logistic(train: DataFrame, features: str, label: str, c: float = 2.0, iterations: int = 200) -> PipelineModel:
    """Balanced logistic regression: the penalty 1 / (C * sum of weights) is that of a loss summed over rows."""
    weighted = train.join(F.broadcast(class_weights(train, label).select(label, "weight")), label)  # one row per class
    total = weighted.agg(F.sum("weight")).first()[0]
    return PipelineModel([_fitted(LogisticRegression(featuresCol=features, labelCol=label, weightCol="weight", regParam=1 / (c * total), maxIter=iterations, standardization=False), weighted)])


def train_svm(train: DataFrame, features: str, label: str, c: float = 2.0, iterations: int = 100) -> PipelineModel:
    """A linear machine, then a logistic curve over its margin for probabilities. Two classes, 0 and 1."""
    weighted = train.join(F.broadcast(class_weights(train, label).select(label, "weight")), label)
    total = weighted.agg(F.sum("weight")).first()[0]
    svm = LinearSVC(featuresCol=features, labelCol=label, weightCol="weight", regParam=1 / (c * total), maxIter=iterations, rawPredictionCol="margin", predictionCol="svm_prediction", standardization=False)
    platt = LogisticRegression(featuresCol="margin", labelCol=label, predictionCol="prediction", rawPredictionCol="rawPrediction", probabilityCol="probability")
    machine = _fitted(svm, weighted)
    return PipelineModel([machine, _fitted(platt, machine.transform(weighted))])


def prepare(df: DataFrame, mean: np.ndarray, std: np.ndarray, kernel: bool = False, vector: str = "vector") -> DataFrame:
    v = scaled(F.col(vector), mean, std)
    return df.withColumn("features", array_to_vector(fourier_features(v, len(mean)) if kernel else v))


def score(model: PipelineModel, df: DataFrame, classes: list[str], positive: str = "fake", threshold: float | None = None) -> DataFrame:
    """Adds probability (array), pred_label; with a threshold, two classes are told by the positive one's probability."""
    out = model.transform(df).withColumn("probability", vector_to_array("probability"))
    names = F.array(*[F.lit(c) for c in classes])
    best = F.get(names, F.array_position("probability", F.array_max("probability")).cast("int") - 1)
    if threshold is not None and len(classes) == 2:
        k = classes.index(positive) if positive in classes else 0
        best = F.when(F.get("probability", k) >= threshold, classes[k]).otherwise(classes[1 - k])
    return out.withColumn("pred_label", best)


def search(train: DataFrame, features: str, label: str, key: str, trials: int = 25, low: float = 0.01, high: float = 10.0, seed: int = 1337) -> tuple[float, float]:
    """The C, of ``trials`` drawn evenly in logarithm, with the best accuracy on an inner split; the first of equals."""
    inner = stratified_split(train, label, key, 20, f"inner{seed}").cache()
    best = (-1.0, 1.0)
    for c in np.exp(np.random.default_rng(seed).uniform(math.log(low), math.log(high), trials)).tolist():
        model = train_logistic(inner.filter("NOT is_test").drop("is_test"), features, label, c)
        got = MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy").evaluate(model.transform(inner.filter("is_test")))
        if got > best[0] + 1e-12:
            best = (got, c)
    inner.unpersist()
    return best[1], best[0]


def fuse(scores: DataFrame, heads: list[str], label: str, calibration: str = "platt", folds: int = 5) -> DataFrame:
    """Late fusion of head scores by logistic regression; calibrated by itself (platt), isotonic regression, or not at all (margins).

    The isotonic curve is fitted on scores that each of ``folds`` parts gets from a model of the other parts, so no row is
    calibrated by a score it was trained on; equal head scores share a part. Labels are 0 and 1. The models are those of
    train_logistic, fitted together by fit_folds: a step sends a row for each of them to the driver.
    """
    doubles = [F.col(h).cast("double").alias(f"_h{i}") for i, h in enumerate(heads)]
    part = F.pmod(F.xxhash64(*[F.col(h).cast("double") for h in heads]), F.lit(folds)).cast("int") if calibration == "isotonic" else F.lit(-1)
    made = scores.select("*", *doubles, part.alias("_fold"), F.col(label).cast("double").alias("_y")).persist(StorageLevel.MEMORY_AND_DISK)  # for the fits alone
    try:
        return _fused(made, len(heads), calibration, folds)
    finally:
        made.unpersist()


def _fused(made: DataFrame, size: int, calibration: str, folds: int, c: float = 2.0) -> DataFrame:
    names = [f"_h{i}" for i in range(size)]
    weights = fit_folds(made, names, folds if calibration == "isotonic" else 0, c, "logreg", True)
    margin = lambda w: margin_of(names, [F.get(w, i) for i in range(size + 1)])
    lists = F.array(*[F.array(*[F.lit(float(b)) for b in row]) for row in weights])
    chance = lambda m: 1 / (1 + F.exp(-m))
    last = margin(F.get(lists, F.lit(len(weights) - 1)))
    out = made.withColumn("fused", last if calibration == "none" else chance(last))
    if calibration == "isotonic":
        judged = made.select(chance(margin(F.get(lists, "_fold"))).alias("fused"), "_y")
        out = IsotonicRegression(featuresCol="fused", labelCol="_y", predictionCol="calibrated").fit(judged).transform(out).withColumn("fused", F.col("calibrated"))
    return out.drop("_fold", "_y", *names)

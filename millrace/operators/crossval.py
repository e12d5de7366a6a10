"""Cross-validated late fusion: the models of all folds are fitted together, one grouped aggregate a step."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.metrics import roc_auc


def margin_of(heads: list[str], weights: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(h) * w for h, w in zip(heads, weights[1:], strict=True)], weights[0])


def _losses(margin: Column, y: Column, model: str) -> tuple[Column, Column, Column]:
    """Loss, slope and curvature in the margin: logistic, or the squared hinge of a linear machine."""
    if model == "logreg":
        p = 1 / (1 + F.exp(-margin))
        return F.greatest(margin, F.lit(0.0)) - margin * y + F.log1p(F.exp(-F.abs(margin))), p - y, p * (1 - p)
    sign = 2 * y - 1
    short = F.greatest(1 - sign * margin, F.lit(0.0))
    return short * short, -2 * short * sign, F.when(short > 0, 2.0).otherwise(0.0)


def fit_folds(rows: DataFrame, heads: list[str], folds: int, c: float, model: str, balanced: bool, rounds: int = 60) -> np.ndarray:
    """(folds + 1, heads + 1) weights, the constant first: row k is fitted without fold k, the last on all rows.

    Newton steps with halving on C * sum of losses + half the squared weights (the constant is free). A step is one aggregate that gives
    every fold's loss, gradient and curvature; the driver holds these few numbers alone. Heads are few: the sums are their square.
    """
    d = len(heads) + 1
    counts = {(r["_fold"], r["_y"]): r["n"] for r in rows.groupBy("_fold", "_y").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows a fold
    weight = np.ones((folds + 1, 2))
    for k in range(folds + 1):
        n = [sum(m for (f, y), m in counts.items() if y == z and f != k) for z in (0.0, 1.0)]
        if min(n) == 0:
            raise ValueError(f"the rows outside fold {k} have one class alone")
        if balanced:
            weight[k] = [sum(n) / (2 * m) for m in n]
    ridge = np.diag([0.0] + [1.0] * (d - 1))
    at, accepted = np.zeros((folds + 1, d)), [None] * (folds + 1)
    xs = [F.lit(1.0), *[F.col(h) for h in heads]]
    for _ in range(rounds):
        each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.array(*[F.lit(float(b)) for b in at[k]]).alias("b"), F.lit(float(weight[k, 0])).alias("w0"), F.lit(float(weight[k, 1])).alias("w1")) for k in range(folds + 1)])).alias("m")
        loss, slope, bend = _losses(F.col("z"), F.col("_y"), model)
        rated = rows.select("_fold", "_y", *heads, each).filter("m.k != _fold").withColumn("z", margin_of(heads, [F.get("m.b", i) for i in range(d)]))
        w = F.when(F.col("_y") > 0, F.col("m.w1")).otherwise(F.col("m.w0"))
        rated = rated.select(F.col("m.k").alias("k"), *heads, (loss * w).alias("l"), (slope * w).alias("g"), (bend * w).alias("h"))
        sums = [F.sum("l").alias("l"), *[F.sum(F.col("g") * xs[i]).alias(f"g{i}") for i in range(d)], *[F.sum(F.col("h") * xs[i] * xs[j]).alias(f"h{i}_{j}") for i in range(d) for j in range(i + 1)]]
        done = True
        for r in rated.groupBy("k").agg(*sums).collect():  # one row a fold
            k = r["k"]
            value = c * r["l"] + 0.5 * float(at[k] @ ridge @ at[k])
            if accepted[k] is not None and value > accepted[k][1] + 1e-12 * abs(accepted[k][1]):
                at[k], done = (at[k] + accepted[k][0]) / 2, False
                continue
            grad = c * np.array([r[f"g{i}"] for i in range(d)]) + ridge @ at[k]
            half = np.array([[r[f"h{i}_{j}"] if j <= i else 0.0 for j in range(d)] for i in range(d)])
            full = c * (half + half.T - np.diag(np.diag(half))) + ridge
            accepted[k] = (at[k].copy(), value)
            if np.abs(grad).max() > 1e-9 * max(1.0, abs(value)):
                at[k], done = at[k] - np.linalg.lstsq(full, grad, rcond=None)[0], False
        if done:
            break
    return np.array([a[0] for a in accepted])


def cross_validate(scores: DataFrame, heads: list[str], label: str, key: str, folds: int = 5, c: float = 1.0, model: str = "logreg", balanced: bool = False) -> DataFrame:
    """One row per fold (fold, n, accuracy, f1, auc, intercept, coef): measures on the fold of the model fitted without it; and one with fold -1,
    the model of all rows, measured on them.

    Labels are 0 and 1; rows without label go, a head without a value or with NaN is 0. Rows of one key share a fold. ``model``: logreg or linsvm. F1 is 0 where nothing is
    predicted rightly; AUC is null where a fold has one class.
    """
    if model not in ("logreg", "linsvm"):
        raise ValueError(f"unknown model {model}: logreg or linsvm")
    clean = [F.coalesce(F.nanvl(F.col(h).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(f"_h{i}") for i, h in enumerate(heads)]
    named = [f"_h{i}" for i in range(len(heads))]
    rows = scores.filter(F.col(label).isNotNull()).select(F.pmod(F.xxhash64(key), F.lit(folds)).cast("int").alias("_fold"), F.col(label).cast("double").alias("_y"), *clean).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        weights = fit_folds(rows, named, folds, c, model, balanced)
    finally:
        rows.unpersist()
    out = None
    for k in range(folds + 1):
        part = rows.filter(F.col("_fold") == k) if k < folds else rows
        rated = part.withColumn("z", margin_of(named, [F.lit(float(b)) for b in weights[k]]))
        hit, said, is_one = F.col("z") > 0, (F.col("z") > 0).cast("long"), F.col("_y").cast("long")
        counts = rated.agg(F.count(F.lit(1)).alias("n"), F.avg((hit == (F.col("_y") > 0)).cast("double")).alias("accuracy"), F.coalesce(F.try_divide(2.0 * F.sum(said * is_one), F.sum(said + is_one)), F.lit(0.0)).alias("f1"))
        row = counts.join(roc_auc(rated, "_y", "z"), F.lit(True)).select(  # a row each
            F.lit(k if k < folds else -1).alias("fold"), "n", "accuracy", "f1", "auc", F.lit(float(weights[k, 0])).alias("intercept"), F.array(*[F.lit(float(b)) for b in weights[k, 1:]]).alias("coef")
        )
        out = row if out is None else out.unionByName(row)
    return out

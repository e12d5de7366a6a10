"""Classification metrics over rows of (truth, prediction) or (truth, score)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def accuracy(df: DataFrame, truth: str, pred: str) -> DataFrame:
    return df.agg(F.avg((F.col(truth) == F.col(pred)).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def confusion(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """(truth, pred, n) for every pair of labels that occur, zeros included; the labels alone are paired."""
    labels = df.select(F.explode(F.array(truth, pred)).alias("label")).distinct()
    cells = df.groupBy(F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    every = labels.agg(F.collect_set("label").alias("ls")).select(F.explode("ls").alias("truth"), "ls").select("truth", F.explode("ls").alias("pred"))
    return every.join(cells, ["truth", "pred"], "left").select("truth", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def class_report(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Per class precision, recall, f1 and support, then macro and weighted averages; a division by zero is 0."""
    div = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    both = df.select(F.explode(F.array(F.struct(F.col(truth).alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p"), (F.col(truth) == F.col(pred)).cast("int").alias("tp")), F.struct(F.col(pred).alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("tp")))).alias("r")).select("r.*")
    each = both.groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("t").alias("support"), F.sum("p").alias("predicted"))
    each = each.withColumn("precision", div(F.col("tp").cast("double"), F.col("predicted"))).withColumn("recall", div(F.col("tp").cast("double"), F.col("support")))
    each = each.withColumn("f1", div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    rows = each.select(F.col("label").cast("string").alias("label"), "precision", "recall", "f1", "support")
    macro = rows.agg(F.lit("macro avg").alias("label"), *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")], F.sum("support").alias("support"))
    weighted = rows.agg(F.lit("weighted avg").alias("label"), *[div(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c) for c in ("precision", "recall", "f1")], F.sum("support").alias("support"))
    return rows.unionByName(macro).unionByName(weighted)


def _by_score(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Positives and negatives per distinct score: the curves need no more, and it is counted before the shuffle."""
    return df.groupBy(F.col(score).alias("score")).agg(F.sum(F.col(truth).cast("long")).alias("pos"), F.sum(1 - F.col(truth).cast("long")).alias("neg"))


def _with_below(df: DataFrame, truth: str, score: str, parts: int = 200) -> DataFrame:
    """Adds to each distinct score the rows of both classes below it (``neg_below``, ``pos_below``) and in all (``neg_all``, ``pos_all``).

    Scores are cut at ``parts`` quantiles, so no task orders all of them: each range runs its own window, and the totals of
    the ranges, at most ``parts`` + 1 rows, are summed up and broadcast. Null scores count as the least, NaN as the greatest.
    """
    number = F.col(score).cast("double")
    cuts = df.filter(~F.isnan(number)).agg(F.percentile_approx(number, [k / parts for k in range(1, parts)], 10 * parts)).first()[0]
    cuts = sorted(set(cuts or []))
    each = _by_score(df, truth, score).withColumn("_part", F.size(F.filter(F.lit(cuts), lambda c: c < F.col("score").cast("double"))) if cuts else F.lit(0))
    parted = each.groupBy("_part").agg(F.sum("neg").alias("n"), F.sum("pos").alias("p"))
    up, whole = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    before = parted.select("_part", *[F.coalesce(F.sum(c).over(up), F.lit(0)).alias(f"_{c}") for c in "np"], F.sum("n").over(whole).alias("neg_all"), F.sum("p").over(whole).alias("pos_all"))
    inside = Window.partitionBy("_part").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    below = lambda c: F.col(f"_{c[0]}") + F.coalesce(F.sum(c).over(inside), F.lit(0))
    return each.join(F.broadcast(before), "_part").select("score", "pos", "neg", "pos_all", "neg_all", below("pos").alias("pos_below"), below("neg").alias("neg_below"))


def roc_auc(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Mann-Whitney form with ties counted half; null for one class alone."""
    won = _with_below(df, truth, score).withColumn("w", F.col("pos") * (F.col("neg_below") + F.col("neg") / 2))
    return won.agg(F.try_divide(F.sum("w"), (F.sum("pos") * F.sum("neg")).cast("double")).alias("auc"))


def roc_points(df: DataFrame, truth: str, score: str) -> DataFrame:
    """(threshold, fpr, tpr) for each distinct score taken as the least that counts as positive."""
    share = lambda c: F.try_divide((F.col(f"{c}_all") - F.col(f"{c}_below")).cast("double"), F.col(f"{c}_all"))
    return _with_below(df, truth, score).select(F.col("score").alias("threshold"), share("neg").alias("fpr"), share("pos").alias("tpr"))


def top_k(df: DataFrame, score: str, seq: str, k: int, ascending: bool = False) -> DataFrame:
    order = F.asc(score) if ascending else F.desc(score)
    return df.orderBy(order, seq).limit(k)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights N / (classes * n)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy()
    return counts.select(label, "n", (F.sum("n").over(w) / (F.count(F.lit(1)).over(w) * F.col("n"))).alias("weight"))


def encode_labels(df: DataFrame, label: str) -> DataFrame:
    """(label, code): codes from 0 in label order."""
    return df.select(label).distinct().withColumn("code", (F.row_number().over(Window.orderBy(label)) - 1).cast("int"))


def stratified_split(df: DataFrame, label: str, key: str, test_percent: int, seed: str) -> DataFrame:
    """Adds ``is_test``: per class the first ``test_percent`` of rows in hash order.

    Ranks come in two steps, within the first three digits of the hash and from the counts of the digits before, so a class
    is spread over up to 4096 tasks.
    """
    hashed = df.withColumn("_hash", F.md5(F.concat(F.col(key).cast("string"), F.lit(seed)))).withColumn("_part", F.substring("_hash", 1, 3))
    counts = hashed.groupBy(F.col(label).alias("_label"), F.col("_part").alias("_counted")).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("_label")
    before = counts.select("_label", "_counted", F.sum("_n").over(w).alias("_all"), (F.sum("_n").over(w.orderBy("_counted").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    ranked = hashed.withColumn("_rank", F.row_number().over(Window.partitionBy(label, "_part").orderBy("_hash", key)))
    placed = ranked.join(before, F.col(label).eqNullSafe(F.col("_label")) & F.col("_part").eqNullSafe(F.col("_counted")))
    return placed.select(*df.columns, ((F.col("_before") + F.col("_rank")) * 100 <= F.col("_all") * test_percent).alias("is_test"))

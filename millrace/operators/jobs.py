"""Composed jobs: manifests from protocols, splice detection, alignment with a reference log, evaluation of predictions."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import changepoint, manifests, metrics, series
from millrace.operators.frames import kept
from millrace.operators.windows import sliding_windows, with_index


def build_manifests(entries: DataFrame, files: DataFrame, subsets: tuple[str, ...] = ("train", "dev"), spans_of_real: bool = False, folders: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Clips (subset, path, label) and segments (subset, path, start_sec, end_sec) of protocol entries (token, label, segs).

    ``files`` has (subset, path). A token is resolved within each subset by its path under the subset's folder or the one
    above (``folders``, where given), its name or stem, or its name with .wav, then by the column ``last`` of the entries, if
    they have it; the first of ``subsets`` that has it counts. Entries that no file meets go. Spans of real entries go unless asked for.
    """
    rank = F.array_position(F.array(*[F.lit(s) for s in subsets]), F.col("subset"))
    found, named = None, ["token", "last"] if "last" in entries.columns else ["token"]
    for subset in subsets:
        index = manifests.path_index(files.filter(F.col("subset") == subset), "path")
        hit = manifests.resolve(entries.select(*named).distinct(), "token", index, (folders or {}).get(subset), "last" if "last" in named else None).withColumn("subset", F.lit(subset))
        found = hit if found is None else found.unionByName(hit)
    chosen = found.groupBy(*named).agg(F.min_by(F.struct("subset", "path"), rank).alias("r")).select(*[F.col(c).alias(f"_{c}") for c in named], "r.*")
    placed = entries.select(*named, "label", "segs").join(chosen, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in named]))
    clips = placed.select("subset", "path", "label").dropDuplicates()
    wanted = placed if spans_of_real else placed.filter("label = 'fake'")
    segments = wanted.select("subset", "path", F.explode("segs").alias("x")).select("subset", "path", F.col("x.s").alias("start_sec"), F.col("x.e").alias("end_sec")).dropDuplicates()
    return clips, segments


def splice_points(frames: DataFrame, key: str, t: str, features: list[str], win_sec: float = 1.5, hop_sec: float = 0.5, penalty: float = 10.0, min_size: int = 5, breaks: int = 0, gap_sec: float = 0.7, robust: bool = True) -> DataFrame:
    """Per series (key, n_windows, boundaries_sec): window statistics, change points, boundaries in seconds, close ones merged.

    Window lengths in frames follow each series' own frame rate. A series without a boundary has an empty list.
    """
    paced = frames.join(series.frame_rate(frames, key, t), key)
    win, hop = series.frames_of(win_sec, F.col("fps")), series.frames_of(hop_sec, F.col("fps"))
    aggs = [F.max_by(t, "idx").alias("_t")]
    for f in features:  # one list of values for the three
        aggs += [F.percentile(f, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"_q_{f}")] if robust else [F.avg(f).alias(f"{f}_a"), F.stddev_pop(f).alias(f"{f}_b")]
    windows = sliding_windows(with_index(paced, key, [t]), key, win, hop).groupBy(key, "window_idx").agg(*aggs)
    if robust:
        spread = [c for f in features for c in (F.get(f"_q_{f}", F.lit(1)).alias(f"{f}_a"), (F.get(f"_q_{f}", F.lit(2)) - F.get(f"_q_{f}", F.lit(0))).alias(f"{f}_b"))]
        windows = windows.select(key, "window_idx", "_t", *spread)
    # Both are read more than once, and come from Python steps.
    windows = kept(windows)
    points = kept(changepoint.change_points(windows, key, "window_idx", "_t", [f"{f}_{s}" for f in features for s in "ab"], penalty, min_size, breaks))
    merged = series.merge_close(points, key, "boundary_t", gap_sec)
    counts = windows.groupBy(key).agg(F.count(F.lit(1)).alias("n_windows"))
    return counts.join(merged, key, "left").select(key, "n_windows", F.coalesce("kept", F.array().cast("array<double>")).alias("boundaries_sec"))


def align(tracks: DataFrame, log: DataFrame, key: str, step: int = 1, max_lag_sec: int = 120, linear: bool = True) -> DataFrame:
    """Per track (key, ok, reason, lag_sec, rho_max, n_overlap) against one reference log (t, fi): both on a grid, detrended, correlated.

    Reasons: fewer than 4 points of the track, fewer than 4 of the log, fewer than 16 common grid points.
    """
    counts = tracks.groupBy(key).agg(F.count("fi").alias("n_track"))
    n_log = log.filter("fi IS NOT NULL").count()
    a = series.interpolate_grid(tracks, key, "t", "fi", step)
    b = series.interpolate_grid(log.select(F.lit(0).alias("_one"), "t", "fi"), "_one", "t", "fi", step).select("g", F.col("v").alias("y"))
    both = a.join(b, "g").select(key, F.col("g").cast("long").alias("i"), F.col("v").alias("x"), "y")
    overlap = both.groupBy(key).agg(F.count(F.lit(1)).alias("n_overlap"))
    enough = both.join(overlap.filter("n_overlap >= 16"), key, "left_semi")
    for c in ("x", "y"):
        made = series.detrend(enough, key, c, "i").withColumn(c, F.col("detrended")).drop("detrended") if linear else enough.withColumn(c, series.demean(c, key))
        enough = made.withColumn(c, series.zscore(c, key))
    best = series.best_lag(series.lagged_correlation(enough, key, "i", "x", "y", max_lag_sec // step), key)
    out = counts.join(overlap, key, "left").join(best, key, "left")
    reason = F.when(F.col("n_track") < 4, "too few points in the track").when(F.lit(n_log) < 4, "too few points in the log").when(F.coalesce("n_overlap", F.lit(0)) < 16, "too little overlap")
    return out.select(key, reason.isNull().alias("ok"), reason.alias("reason"), F.when(reason.isNull(), F.col("best_lag") * step).alias("lag_sec"), F.when(reason.isNull(), F.col("rho_max")).alias("rho_max"), F.coalesce("n_overlap", F.lit(0)).alias("n_overlap"))


def evaluate(predictions: DataFrame, classes: list[str], positive: str = "fake", k: int = 20) -> dict[str, DataFrame]:
    """Accuracy, report, confusion matrix, AUC and extreme rows of predictions (path, true_label, pred_label, probability)."""
    at = classes.index(positive) if positive in classes else 0
    scored = predictions.withColumn("score", F.get("probability", at)).withColumn("is_positive", (F.col("true_label") == classes[at]).cast("int"))
    return {
        "accuracy": metrics.accuracy(predictions, "true_label", "pred_label"), "report": metrics.class_report(predictions, "true_label", "pred_label"), "confusion": metrics.confusion(predictions, "true_label", "pred_label"),
        "auc": metrics.roc_auc(scored, "is_positive", "score"), "top": metrics.top_k(scored, "score", "path", k), "bottom": metrics.top_k(scored, "score", "path", k, ascending=True),
    }


def save_model(model: PipelineModel, info: DataFrame, path: str) -> None:
    """The model and, beside it, a row of its classes, dimension and configuration hash."""
    model.write().overwrite().save(f"{path}/model")
    info.write.mode("overwrite").json(f"{path}/info")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, DataFrame]:
    return PipelineModel.load(f"{path}/model"), spark.read.json(f"{path}/info")


def collect_reports(spark: SparkSession, folder: str) -> DataFrame:
    """(tag, metrics, n_predictions) of files <tag>.metrics.json and <tag>.preds.csv in a folder; tags that have one alone stay."""
    tag = lambda suffix: F.regexp_replace(F.col("_metadata.file_name"), suffix, "")
    found = spark.read.text(folder, pathGlobFilter="*.metrics.json", wholetext=True).select(tag(r"\.metrics\.json$").alias("tag"), F.col("value").alias("metrics"))
    preds = spark.read.csv(folder, header=True, pathGlobFilter="*.preds.csv").groupBy(tag(r"\.preds\.csv$").alias("tag")).agg(F.count(F.lit(1)).alias("n_predictions"))
    return found.join(preds, "tag", "full")

"""Queries that SQL cannot express: change points, signal features, learning and streams. Their tests hold them against plain NumPy."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import arrays as A
from millrace.operators import changepoint, extract, learning, metrics, windows
from millrace.operators import jobs as job
from millrace.plans.series_queries import ORDER, events, r6, table
from millrace.streaming import jobs

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(job):
    QUERIES[job.__name__] = job
    return job


def window_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    aggs = [F.avg("value").alias("mean_v"), F.stddev_pop("value").alias("std_v"), F.max("t").alias("t_end")]
    return windows.window_stats(events(spark, sf_dir), "user_id", ORDER, "value", 10, 2, aggs)


@query
def cpd_pelt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changepoint.change_points(window_vectors(spark, sf_dir), "user_id", "window_idx", "t_end", ["mean_v", "std_v"], penalty=1.0, min_size=3)


@query
def cpd_binseg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changepoint.change_points(window_vectors(spark, sf_dir), "user_id", "window_idx", "t_end", ["mean_v", "std_v"], min_size=3, breaks=2)


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings repeated to a length that has frames, in the place of recordings."""
    y = F.flatten(F.array_repeat(A.peak_normalize(A.doubles("embedding")), 128))
    return table(spark, sf_dir, "embeddings").select(F.concat(F.lit("clip/"), "vec_id").alias("path"), y.alias("y"), F.lit(16000).alias("sr"))


def described(features: DataFrame) -> DataFrame:
    v = F.transform("vector", lambda x: x.cast("double"))
    return features.select("path", "cfg_hash", F.size("vector").alias("dim"), F.round(A.mean(v), 4).alias("mean_v"), "status")


@query
def mfcc_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return described(extract.extract_features(clips(spark, sf_dir), [extract.MfccConfig()]))


@query
def ambient_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return described(extract.extract_features(clips(spark, sf_dir), [extract.AmbientConfig()]))


@query
def enf_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return described(extract.extract_features(clips(spark, sf_dir), [extract.HumConfig(bandwidth=3.0)]))


@query
def zero_cross_bandpass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return described(extract.extract_features(clips(spark, sf_dir), [extract.HumConfig(strategy="zc")]))


@query
def combined_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return described(extract.extract_features(clips(spark, sf_dir), [extract.AmbientConfig(), extract.MfccConfig()]))


def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") < 5).cast("double").alias("label"), A.doubles("embedding").alias("vector"))
    return metrics.stratified_split(df, "label", "vec_id", 20, "1337")


def evaluated(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    df = split(spark, sf_dir)
    mean, std = learning.scale_columns(df.filter("NOT is_test"))
    ready = learning.prepare(df, mean, std, kernel=kind == "rff")
    train = learning.train_logistic if kind == "logreg" else learning.train_svm
    model = train(ready.filter("NOT is_test"), "features", "label")
    out = learning.score(model, ready.filter("is_test"), ["fake", "real"])
    return out.select("vec_id", "label", r6(F.get("probability", 1), "prob_real"), "pred_label")


@query
def logreg_train_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluated(spark, sf_dir, "logreg")


@query
def linear_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluated(spark, sf_dir, "svm")


@query
def rff_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluated(spark, sf_dir, "rff")


@query
def hyperparameter_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = split(spark, sf_dir).filter("NOT is_test").drop("is_test").withColumn("features", array_to_vector("vector"))
    c, accuracy = learning.search(df, "features", "label", "vec_id", trials=4)
    return spark.createDataFrame([(c, accuracy)], "c double, accuracy double")


@query
def late_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = [f"head{i}" for i in range(4)]  # each the mean of a quarter of the embedding
    scores = split(spark, sf_dir).select("vec_id", "label", *[(A.total(F.slice("vector", 16 * i + 1, 16)) / 16).alias(h) for i, h in enumerate(heads)])
    return learning.fuse(scores, heads, "label", "isotonic").select("vec_id", "label", r6("fused", "fused"))


def _drained(stream: DataFrame, mode: str) -> DataFrame:
    """A bounded stream run to its end, in a folder of its own."""
    folder = stream.sparkSession.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='millrace-stream-')}"
    return jobs.drain(stream, mode, f"{folder.rstrip('/')}/streams/{uuid.uuid4().hex}")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.read_stream(spark, sf_dir, "events.parquet", table(spark, sf_dir, "events").schema)


@query
def stream_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = event_stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    return _drained(jobs.window_counts(stream, "ts", "event_type"), "update").groupBy(F.col("w").cast("timestamp_ntz").alias("w"), "event_type").agg(F.max("n").alias("n"))


ORACLES["stream_window_counts"] = "SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS w, event_type, count(*) AS n FROM events GROUP BY ALL"


@query
def stream_merge_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = event_stream(spark, sf_dir).select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    return _drained(jobs.merge_close_stream(stream, "user_id", "t", 86400.0), "append").select("user_id", F.round("kept", 3).alias("kept"))


ORACLES["stream_merge_close"] = """WITH RECURSIVE s AS (SELECT user_id, epoch_us(ts) / 1000000.0::DOUBLE AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS rk FROM events),
     f AS (SELECT user_id, rk, t AS kept FROM s WHERE rk = 1 UNION ALL SELECT s.user_id, s.rk, CASE WHEN s.t - f.kept >= 86400 THEN s.t ELSE f.kept END FROM f JOIN s ON s.user_id = f.user_id AND s.rk = f.rk + 1)
SELECT DISTINCT user_id, round(kept, 3)::DOUBLE AS kept FROM f"""


@query
def splice_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = job.splice_points(events(spark, sf_dir), "user_id", "t", ["value"], win_sec=200_000.0, hop_sec=40_000.0, penalty=1.0, min_size=3, gap_sec=86_400.0)
    return out.select("user_id", "n_windows", F.size("boundaries_sec").cast("long").alias("n_boundaries"))


@query
def align_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("user_id", "t", F.col("value").alias("fi"))
    return job.align(e, e.filter("user_id = 2"), "user_id", step=21_600, max_lag_sec=6 * 21_600).select("user_id", "ok", "reason", "lag_sec", r6("rho_max", "rho_max"), "n_overlap")

"""Composed jobs on small tables with known answers."""

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Observation
from pyspark.sql import functions as F

from millrace.operators import jobs, learning

SEGS = "array<struct<s:double,e:double>>"


def test_manifests(spark):
    entries = spark.createDataFrame([("a", "fake", [(1.0, 2.0)]), ("b.wav", "real", [(3.0, 4.0)]), ("gone", "fake", [])], f"token string, label string, segs {SEGS}")
    files = spark.createDataFrame([("dev", "d/a.wav"), ("train", "t/a.flac"), ("dev", "d/b.wav")], "subset string, path string")
    clips, segments = jobs.build_manifests(entries, files)
    assert sorted(tuple(r) for r in clips.collect()) == [("dev", "d/b.wav", "real"), ("train", "t/a.flac", "fake")]
    assert [tuple(r) for r in segments.collect()] == [("train", "t/a.flac", 1.0, 2.0)]
    assert jobs.build_manifests(entries, files, spans_of_real=True)[1].count() == 2


def test_splice_points(spark):
    rng = np.random.default_rng(0)
    rows = [("step", i * 0.1, float(i >= 100) * 5 + float(rng.normal(scale=0.1))) for i in range(200)] + [("short", i * 0.1, 1.0) for i in range(3)]
    out = {r["k"]: r for r in jobs.splice_points(spark.createDataFrame(rows, "k string, t double, v double"), "k", "t", ["v"], penalty=1.0).collect()}
    assert len(out["step"]["boundaries_sec"]) >= 1 and min(abs(b - 10.0) for b in out["step"]["boundaries_sec"]) < 1.0
    assert out["short"]["n_windows"] == 1 and out["short"]["boundaries_sec"] == []


def test_alignment(spark):
    x = 50 + np.cumsum(np.random.default_rng(1).normal(size=200)) / 100
    log = spark.createDataFrame([(float(i), float(x[i])) for i in range(200)], "t double, fi double")
    tracks = [("hit", float(i), float(x[i + 7])) for i in range(100)] + [("few", 1.0, 50.0)] + [("far", 1000.0 + i, 50.0) for i in range(30)]
    out = {r["k"]: r for r in jobs.align(spark.createDataFrame(tracks, "k string, t double, fi double"), log, "k", max_lag_sec=20).collect()}
    assert out["hit"]["ok"] and out["hit"]["lag_sec"] == 7 and out["hit"]["rho_max"] > 0.99
    assert out["few"]["reason"] == "too few points in the track" and out["far"]["reason"] == "too little overlap"


def test_evaluation(spark):
    rows = [("a", "fake", "fake", [0.9, 0.1]), ("b", "real", "fake", [0.6, 0.4]), ("c", "real", "real", [0.2, 0.8])]
    out = jobs.evaluate(spark.createDataFrame(rows, "path string, true_label string, pred_label string, probability array<double>"), ["fake", "real"], k=1)
    assert abs(out["accuracy"].first()["accuracy"] - 2 / 3) < 1e-12 and out["auc"].first()["auc"] == 1.0
    assert out["top"].first()["path"] == "a" and out["bottom"].first()["path"] == "c"


def test_reports(spark, tmp_path):
    (tmp_path / "svm.metrics.json").write_text('{"accuracy": 1}')
    (tmp_path / "svm.preds.csv").write_text("path,p\na,1\nb,2\n")
    (tmp_path / "lr.preds.csv").write_text("path,p\na,1\n")
    assert sorted((r["tag"], r["n_predictions"]) for r in jobs.collect_reports(spark, str(tmp_path)).collect()) == [("lr", 1), ("svm", 2)]


def test_every_user_is_aligned_and_every_frame_transformed(spark):
    from millrace.plans import catalog

    data, found = "/root/testdata/sf0.001", catalog.queries()
    users = spark.read.parquet(f"{data}/events.parquet").select("user_id").distinct()
    aligned = found["align_job"](spark, data).select("user_id")
    assert aligned.count() == users.count() and users.join(aligned, "user_id", "left_anti").isEmpty()
    frames = found["frame_signal"](spark, data).count()
    assert found["band_peak_track_frames"](spark, data).count() == frames and found["dft_magnitude_frames"](spark, data).count() == 9 * frames


def test_models_score_in_a_session_that_observed(spark):
    """A session whose observations were read cannot be serialized, so no model may hold it."""
    seen = Observation()
    rows = spark.createDataFrame([(i, float(i % 2), [float(i % 2) + i / 40, float(i % 3)]) for i in range(40)], "key long, label double, vector array<double>")
    rows.observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get == {"n": 40}
    ready = rows.withColumn("features", array_to_vector("vector"))
    for train in (learning.train_logistic, learning.train_svm):
        out = learning.score(train(ready, "features", "label"), ready, ["fake", "real"]).select("label", "pred_label").collect()
        assert np.mean([r["pred_label"] == ("real" if r["label"] else "fake") for r in out]) > 0.9
    assert learning.search(ready, "features", "label", "key", trials=2)[1] > 0.7

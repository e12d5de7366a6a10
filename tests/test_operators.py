"""Edge cases of the relational and series operators on small tables."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from millrace.functions import arrays as A
from millrace.functions import text as T
from millrace.operators import extract, jobs as composed, manifests, metrics, series, windows
from millrace.sources import readers
from millrace.streaming import jobs


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_spans_and_pairs(spark):
    s = lambda text: [tuple(r) for r in one(spark, T.spans(F.lit(text)))]
    assert s("0.00-1.20-T/1.20-2.50-F") == [(0.0, 1.2), (1.2, 2.5)]
    assert s("4 : 3") == [(3.0, 4.0)] and s("none") == []
    pairs = one(spark, T.number_pairs(F.array(*[F.lit(x) for x in ("a", "5", "2", "9")])))
    assert [tuple(r) for r in pairs] == [(2.0, 5.0)]
    ms = one(spark, T.milliseconds_to_seconds(T.spans(F.lit("3000-4000/2-9000"))))
    assert [tuple(r) for r in ms] == [(3.0, 4.0), (0.002, 9.0)]
    assert [tuple(r) for r in one(spark, T.json_segments(F.lit('[[3, 1], [4, 5]]')))] == [(1.0, 3.0), (4.0, 5.0)]
    assert [tuple(r) for r in one(spark, T.json_segments(F.lit('[{"start": 1, "end": 2}]')))] == [(1.0, 2.0)]
    assert one(spark, T.json_segments(F.lit("{broken"))) == []


def test_labels(spark):
    got = [one(spark, T.normalize_label(F.lit(x))) for x in ("Bona-Fide", " SPOOF ", "partially fake", "real fake", "", None)]
    assert got == ["real", "fake", "fake", "real", "real", "real"]


def test_arrays(spark):
    v = F.array(*[F.lit(x) for x in (3.0, 3.0, 1.0)])
    assert one(spark, A.first_argmax(v)) == 0
    assert abs(sum(one(spark, A.softmax(v))) - 1) < 1e-12
    assert one(spark, A.frames(v, 5, 1)) == []
    assert one(spark, A.sanitize(F.array(F.lit(float("nan")), F.lit(float("-inf"))))) == [0.0, -1e6]
    assert one(spark, A.peak_normalize(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]
    assert one(spark, A.sign_changes(F.array(F.lit(1.0), F.lit(-0.0), F.lit(2.0)))) == [1, 2]


def test_merge_close(spark):
    df = spark.createDataFrame([("a", t) for t in (0.1, 0.5, 0.9, 1.2, 1.7)], "k string, t double")
    assert series.merge_close(df, "k", "t", 0.7).first()["kept"] == [0.1, 0.9, 1.7]


def test_shifted_copy_has_its_lag(spark):
    x = np.random.default_rng(3).normal(size=80)
    rows = [("a", i, float(x[i + 3]), float(x[i])) for i in range(70)]
    df = spark.createDataFrame(rows, "k string, i long, x double, y double")
    best = series.best_lag(series.lagged_correlation(df, "k", "i", "x", "y", 6), "k").first()
    assert best["best_lag"] == 3 and best["rho_max"] > 0.999
    flat = spark.createDataFrame([("a", i, 1.0, 1.0) for i in range(9)], "k string, i long, x double, y double")
    assert {r["r"] for r in series.lagged_correlation(flat, "k", "i", "x", "y", 2).collect()} == {0.0}


def test_interpolation_is_numpys(spark):
    t, v = [0.0, 2.5, 7.0, 9.9], [1.0, 4.0, -2.0, 3.0]
    df = spark.createDataFrame(list(zip(["a"] * 4, t, v, strict=True)), "k string, t double, v double")
    got = {r["g"]: r["v"] for r in series.interpolate_grid(df, "k", "t", "v", 1).collect()}
    assert sorted(got) == list(range(10)) and np.allclose([got[g] for g in range(10)], np.interp(range(10), t, v))


def test_metrics_of_one_class(spark):
    df = spark.createDataFrame([(1, 1, 0.3), (1, 0, 0.4)], "t int, p int, s double")
    assert metrics.roc_auc(df, "t", "s").first()["auc"] is None
    report = {r["label"]: r for r in metrics.class_report(df, "t", "p").collect()}
    assert report["0"]["precision"] == 0 and report["1"]["recall"] == 0.5


def test_resolution_priority(spark):
    files = spark.createDataFrame([("x/A.wav",), ("y/b.flac",), ("z/a",)], "p string")
    tokens = spark.createDataFrame([("a",), ("B.FLAC",), ("none",)], "token string")
    got = {r["token"]: r["path"] for r in manifests.resolve(tokens, "token", manifests.path_index(files, "p")).collect()}
    assert got == {"a": "x/A.wav", "B.FLAC": "y/b.flac"}


def test_overlaps_are_all_and_once(spark):
    a = spark.createDataFrame([("k", 1, 0.0, 10.0), ("k", 2, 20.0, 21.0)], "k string, id long, s double, e double")
    b = spark.createDataFrame([("k", 7, 1.0, 9.0), ("k", 8, 10.0, 20.0), ("k", 9, 20.5, 30.0)], "k string, id long, s double, e double")
    got = sorted((r["id"], r["id2"]) for r in manifests.interval_overlaps(a, b, "k", 2.0).collect())
    assert got == [(1, 7), (2, 9)]


def test_nms(spark):
    e = spark.createDataFrame([("k", 1, 0.0, 2.0, 0.9), ("k", 2, 0.1, 2.1, 0.8), ("k", 3, 5.0, 6.0, 0.7)], "k string, id long, s double, e double, score double")
    assert [x["id"] for x in manifests.nms(e, "k").first()["kept"]] == [1, 3]


def test_extraction_job(spark):
    y = np.sin(np.arange(8000) / 5).tolist()
    clips = spark.createDataFrame([("a", y, 16000), ("b", [0.1] * 100, 16000)], "path string, y array<float>, sr int")
    out = extract.extract_features(clips, [extract.MfccConfig()]).cache()
    rows = {r["path"]: r for r in out.collect()}
    assert rows["a"]["status"] == "ok" and len(rows["a"]["vector"]) == 80 and rows["b"]["status"].startswith("err")
    assert extract.extract_missing(clips, out, [extract.MfccConfig()]).select("path").collect()[0]["path"] == "b"
    assert extract.extract_missing(clips, out, [extract.MfccConfig(n_mels=30)]).count() == 2


def test_readers(spark, tmp_path):
    import wave

    (tmp_path / "log.csv").write_text("time,fi\n1,50.1\nx,2\n2,\n1,49\n3,50.3\n")
    got = sorted(tuple(r) for r in readers.frequency_log(spark, str(tmp_path / "log.csv"), scale=2.0).collect())
    assert got == [(2.0, 50.1), (6.0, 50.3)]
    (tmp_path / "lab.txt").write_text("# note\n\nu1, fake, 1-2\nu2 genuine\nalone\n")
    rows = {r["token"]: r for r in readers.label_lines(spark, str(tmp_path / "lab.txt")).collect()}
    assert rows["u1"]["label"] == "fake" and len(rows["u1"]["segs"]) == 1 and rows["u2"]["label"] == "real" and len(rows) == 2
    (tmp_path / "p.json").write_text('{"entries": [{"path": "a"}, {"path": "b"}]}')
    assert {r["path"] for r in readers.json_items(spark, str(tmp_path / "p.json"), "struct<path:string>").collect()} == {"a", "b"}
    (tmp_path / "bad.json").write_text("{oops")
    assert readers.json_items(spark, str(tmp_path / "bad.json"), "struct<path:string>").count() == 0
    (tmp_path / "t" / "fake").mkdir(parents=True)
    with wave.open(str(tmp_path / "t" / "fake" / "a.wav"), "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes((np.sin(np.arange(1600) / 4).repeat(2) * 9000).astype("<i2").tobytes())
    (tmp_path / "t" / "fake" / "b.wav").write_bytes(b"nothing")
    files = readers.audio_files(spark, str(tmp_path / "t"))
    assert {r["label"] for r in files.select("label").collect()} == {"fake"}
    audio = {r["path"].rpartition("/")[2]: r for r in readers.load_audio(files).collect()}
    assert audio["a.wav"]["status"] == "ok" and abs(len(audio["a.wav"]["y"]) - 3200) <= 1 and audio["b.wav"]["status"].startswith("err")
    table = spark.createDataFrame([("f1", "spoof")], "File string, Label string")
    assert tuple(readers.protocol(table).first()) == ("f1", "fake", [])
    (tmp_path / "t" / "real" / "x").mkdir(parents=True)
    (tmp_path / "t" / "real" / "x" / "c.wav").write_bytes(b"nothing")
    (tmp_path / "t" / "loose.wav").write_bytes(b"nothing")
    found = {r["path"].rpartition("/")[2]: r["label"] for r in readers.audio_files(spark, str(tmp_path / "t")).select("path", "label").collect()}
    assert found == {"a.wav": "fake", "b.wav": "fake", "c.wav": "real"}


def test_protocols_by_their_synonyms(spark):
    rows = [("7", "u1", "bonafide", "1.0-2.5; 3:4", "", ""), ("8", "u2", "spoof", "", "5", "4.5"), ("9", "u3", "spoof", "[[1, 2], [3, 4.5]]", "", ""), ("10", "u4", None, None, "x", None)]
    table = spark.createDataFrame(rows, "id string, utterance string, bonafide_spoof string, regions string, onset string, t1 string")
    got = {r["path"]: (r["label"], [tuple(x) for x in r["segs"]]) for r in readers.protocol(table).collect()}
    assert got["u1"] == ("real", [(1.0, 2.5), (3.0, 4.0)]) and got["u2"] == ("fake", [(4.5, 5.0)]) and got["u4"][1] == []
    assert got["u3"][1] == [(1.0, 2.0), (3.0, 4.5)]


def test_stream_keeps_as_the_batch_does(spark, tmp_path):
    pdf = pd.DataFrame({"k": [1, 1, 1, 2], "t": [0.0, 0.5, 1.5, 3.0]})
    spark.createDataFrame(pdf).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = jobs.merge_close_stream(jobs.read_stream(spark, str(tmp_path / "in"), "*.parquet", "k long, t double"), "k", "t", 1.0)
    query = stream.writeStream.format("memory").queryName("kept").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(tuple(r) for r in spark.table("kept").collect()) == [(1, 0.0), (1, 1.5), (2, 3.0)]


def test_curves_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [(int(rng.random() < 0.4), float(round(rng.normal(), 1 if i % 2 else 4))) for i in range(700)]
    df = spark.createDataFrame(rows, "y int, s double")
    pos, neg = ([s for y, s in rows if y == k] for k in (1, 0))
    won = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    assert abs(metrics.roc_auc(df, "y", "s").first()["auc"] - won) < 1e-12
    for r in metrics.roc_points(df, "y", "s").collect():
        assert abs(r["tpr"] - np.mean(np.array(pos) >= r["threshold"])) < 1e-12 and abs(r["fpr"] - np.mean(np.array(neg) >= r["threshold"])) < 1e-12
    odd = spark.createDataFrame([(1, None), (0, 1.0), (1, float("nan"))], "y int, s double")
    assert metrics.roc_auc(odd, "y", "s").first()["auc"] == 0.5 and metrics.roc_auc(odd.limit(0), "y", "s").first()["auc"] is None


def test_split_takes_the_share_of_every_class(spark):
    import hashlib

    rows = [(i, None if i % 10 == 9 else "a" if i % 3 else "b") for i in range(500)]
    got = {r["k"]: r["is_test"] for r in metrics.stratified_split(spark.createDataFrame(rows, "k long, c string"), "c", "k", 20, "s").collect()}
    for c in ("a", "b", None):
        ids = sorted((i for i, x in rows if x == c), key=lambda i: (hashlib.md5(f"{i}s".encode()).hexdigest(), i))
        assert [got[i] for i in ids] == [(r + 1) * 100 <= len(ids) * 20 for r in range(len(ids))]


def test_close_times_merge_within_stretches(spark):
    rng = np.random.default_rng(4)
    rows = [("k", float(t)) for t in rng.uniform(0, 200, 300)] + [("one", 5.0), ("none", None)]
    kept, last = [], None
    for t in sorted(t for k, t in rows if k == "k"):
        if last is None or t - last >= 1.5:
            kept.append(t)
            last = t
    got = {r["k"]: r["kept"] for r in series.merge_close(spark.createDataFrame(rows, "k string, t double"), "k", "t", 1.5).collect()}
    assert got == {"k": kept, "one": [5.0], "none": []}


def test_windows_of_lengths_that_differ_by_series(spark):
    df = spark.createDataFrame([(k, i, w) for k, w in (("a", 4), ("b", 2)) for i in range(6)], "k string, idx long, w long")
    got = {(r["k"], r["window_idx"]): r["n"] for r in windows.sliding_windows(df, "k", F.col("w"), F.col("w") / 2).groupBy("k", "window_idx").agg(F.count("*").alias("n")).collect()}
    assert got == {("a", 0): 4, ("a", 1): 4} | {("b", j): 2 for j in range(5)}


def test_tokens_with_folders_and_last_columns(spark):
    files = spark.createDataFrame([("train", "/d/train/x/a.wav"), ("train", "/d/train/y/a.wav"), ("train", "/d/z/b.flac"), ("dev", "/d/dev/c.wav")], "subset string, path string")
    entries = spark.createDataFrame([("y/a.wav", None), ("a", None), ("z/b.flac", None), ("gone", "c"), ("b.mp3", None), (" C ", None)], "token string, last string").selectExpr("*", "'real' AS label", "CAST(array() AS array<struct<s:double,e:double>>) AS segs")
    index = manifests.path_index(files.filter("subset = 'train'"), "path")
    got = {r["token"]: r["path"] for r in manifests.resolve(entries, "token", index, "/d/train").collect()}
    assert got == {"y/a.wav": "/d/train/y/a.wav", "a": "/d/train/x/a.wav", "z/b.flac": "/d/z/b.flac"}  # the last under the folder above; b.mp3 is no stem of a file
    clips, _ = composed.build_manifests(entries, files, folders={"train": "/d/train", "dev": "/d/dev"})
    assert sorted((r["subset"], r["path"]) for r in clips.collect()) == [("dev", "/d/dev/c.wav"), ("train", "/d/train/x/a.wav"), ("train", "/d/train/y/a.wav"), ("train", "/d/z/b.flac")]


def test_parts_of_a_cell_do_not_run_together(spark, tmp_path):
    """A span stands within one part of a cell or field: 10;-20 and 1.5|:3 are none."""
    df = spark.createDataFrame([("a", "10;-20"), ("b", "1.5|:3"), ("c", "1-2;3-4")], "path string, segments string")
    got = {r["path"]: [tuple(x) for x in r["segs"]] for r in readers.protocol(df).select("path", "segs").collect()}
    assert got["c"] == [(1.0, 2.0), (3.0, 4.0)] and (10.0, 20.0) not in got["a"] and (1.5, 3.0) not in got["b"]
    (tmp_path / "lines.txt").write_text("clip fake 1-2 3-4\nother fake 10 -20\n")
    lines = {r["token"]: [tuple(x) for x in r["segs"]] for r in readers.label_lines(spark, str(tmp_path / "lines.txt")).collect()}
    assert lines["clip"] == [(1.0, 2.0), (3.0, 4.0)] and (10.0, 20.0) not in lines["other"]

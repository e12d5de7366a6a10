"""Smoothing by seconds, event groups, suppression, the scan of a store and cross-validated fusion: against plain loops, with odd rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import dsp
from millrace.operators import crossval, overlaps, smoothing, store


@pytest.mark.parametrize("method", ["savgol", "median"])
@pytest.mark.parametrize("size", [3, 5, 9, 15, 31])
def test_blocks_smooth_as_the_whole_series(size, method):
    x = np.random.default_rng(size).normal(size=100)
    whole = dsp.smooth(x, 1.0, size, method)
    work = smoothing.fitted if method == "savgol" else smoothing.medians
    for length in (32, 40, 100):
        got = []
        for begin in range(0, 100, length):
            end = min(100, begin + length)
            first, last = max(0, begin - size + 1), min(100, end + size - 1)
            got.append(work(x[first:last], first, begin, end, 100, size))
        assert np.allclose(np.concatenate(got), whole)


def test_every_series_has_its_own_window(spark, monkeypatch):
    monkeypatch.setattr(smoothing, "BLOCK", 16)  # many blocks
    rng = np.random.default_rng(0)
    series = {"slow": (1.0, rng.normal(size=200)), "fast": (0.25, rng.normal(size=300)), "short": (1.0, rng.normal(size=4)), "one": (1.0, rng.normal(size=1)), "odd": (1.0, np.array([1.0, math.nan, 3.0] * 5)), "gone": (1.0, np.zeros(0))}
    rows = [(k, i * step, float(v)) for k, (step, x) in series.items() for i, v in enumerate(x)] + [("slow", None, 1.0)]
    random.Random(0).shuffle(rows)
    df = spark.createDataFrame(rows, "k string, t double, v double").withColumn("idx", F.lit("own"))
    for method in ("savgol", "median"):
        out = smoothing.smooth_seconds(df, "k", "t", "v", 11.0, method).collect()
        assert out[0]["idx"] == "own" and len(out) == len(rows) - 1
        for k in ("slow", "fast", "short") + (("odd",) if method == "savgol" else ()):
            got = [r["smoothed"] for r in sorted((r for r in out if r["k"] == k), key=lambda r: r["t"])]
            step, x = series[k]
            assert np.allclose(got, dsp.smooth(x, 1 / step, 11.0, method), equal_nan=True), (k, method)
    assert smoothing.smooth_seconds(df, "k", "t", "v", 0.0).filter("smoothed <=> v").count() == len(rows) - 1
    assert smoothing.smooth_seconds(df.limit(0), "k", "t", "v", 11.0).count() == 0
    with pytest.raises(ValueError):
        smoothing.smooth_seconds(df, "k", "t", "v", 1.0, "mean")


def plain_groups(rows):
    groups, far = [], None
    for s, e, i in sorted((s, max(s, e), i) for i, s, e in rows):
        if far is None or s >= far:
            groups.append(set())
        groups[-1].add(i)
        far = e if far is None else max(far, e)
    return sorted(map(sorted, groups))


EVENT = "k string, id long, s double, e double, label string, score double, sources array<string>"


@pytest.mark.parametrize("seed", range(3))
def test_groups_overlap_one_through_another(spark, seed):
    rng = random.Random(seed)
    rows = [("k", i, s := rng.randrange(300) / 1.0, s + rng.choice([0, 0, 1, 2, 5, 40]), rng.choice("ab"), rng.random(), [rng.choice("xyz")]) for i in range(80)]
    rows += [(None, 900, 1.0, 2.0, "a", 1.0, None), ("k", 901, None, 2.0, "a", 1.0, []), ("k", 902, 3.0, None, "a", 1.0, [])]
    grouped = overlaps.overlap_groups(spark.createDataFrame(rows, EVENT), "k", 10.0).collect()
    found = {}
    for r in grouped:
        found.setdefault(r["grp"], []).append(r["id"])
    assert sorted(map(sorted, found.values())) == plain_groups([(r[1], r[2], r[3]) for r in rows[:80]])
    starts = [min(r["s"] for r in grouped if r["grp"] == g) for g in sorted(found)]
    assert starts == sorted(starts) and sorted(found) == list(range(len(found)))


def test_fused_groups_unite_labels_and_sources(spark):
    rows = [("k", 1, 0.0, 5.0, "a", 0.3, ["x"]), ("k", 2, 4.0, 9.0, "b", 0.9, ["y", "x"]), ("k", 3, 9.0, 10.0, "a", None, None), ("k", 4, 9.0, 10.0, "a", 0.9, ["z"]), ("k", 5, 9.0, 10.0, None, 0.9, ["z"])]
    out = [tuple(r) for r in overlaps.fuse_groups(spark.createDataFrame(rows, EVENT), "k", 3.0).orderBy("grp").collect()]
    assert out == [("k", 0, 0.0, 9.0, 0.9, 2, 2, ["a", "b"], ["x", "y"]), ("k", 1, 9.0, 10.0, 0.9, 4, 3, ["a"], ["z"])]


def test_suppression_streams_as_the_fold(spark):
    rng = random.Random(5)
    rows = [(k, i, s := rng.randrange(40) / 2, s + rng.choice([1.0, 2.0, 8.0]), "a", rng.randrange(30) / 30, [rng.choice("xyz")]) for k in "abc" for i in range(60)]
    want = set()
    for k in "abc":
        last = None
        for _, i, s, e, _, score, src in sorted((r for r in rows if r[0] == k), key=lambda r: (-r[5], r[2], r[3], r[1])):
            both = max(0.0, min(last[2], e) - max(last[1], s)) if last else 0.0
            if last and both / ((last[2] - last[1]) + (e - s) - both) >= 0.5:
                last[3].update(src)
                continue
            if last:
                want.add((k, last[0], tuple(sorted(last[3]))))
            last = (i, s, e, set(src))
        want.add((k, last[0], tuple(sorted(last[3]))))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # the fold goes on over batches
    try:
        odd = [(None, 1, 0.0, 1.0, "a", 1.0, []), ("n", 1, 0.0, 1.0, "a", None, []), ("p", 1, 2.0, 2.0, "a", 1.0, None), ("p", 2, 2.0, 2.0, "a", 0.5, None)]
        out = overlaps.suppress(spark.createDataFrame(rows + odd, EVENT), "k").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r["k"], r["id"], tuple(r["sources"])) for r in out} == want | {("p", 1, ()), ("p", 2, ())}


def test_scan_counts_what_it_passes_over(spark):
    clips = spark.createDataFrame([(p, "fake") for p in "abcdefg"], "path string, label string")
    held = [("a", [1.0, 2.0], '{"cfg_hash": "h"}'), ("b", None, None), ("c", [1.0], "{}"), ("d", [math.nan, math.inf], "{broken"), ("e", [3.0, 4.0], '{"cfg_hash": "other"}'), ("f", [5.0, 6.0], None), ("not asked", [1.0, 1.0], None)]
    rows, seen = store.scan(clips, spark.createDataFrame(held, "path string, vector array<float>, meta string"), 2, "h")
    got = {r["path"]: (r["vector"], r["cfg_hash"], r["label"]) for r in rows.collect()}
    assert got == {"a": ([1.0, 2.0], "h", "fake"), "d": ([0.0, 1e6], "", "fake"), "e": ([3.0, 4.0], "other", "fake"), "f": ([5.0, 6.0], "", "fake")}
    assert seen.get == {"total": 7, "missing": 1, "bad": 1, "wrong_dim": 1, "used": 4, "other_hash": 1}
    rows, seen = store.scan(clips.limit(0), spark.createDataFrame(held, "path string, vector array<float>, meta string"))
    assert rows.count() == 0 and seen.get["total"] == 0 and seen.get["used"] == 0


def plain_fit(x, y, c, model, w):
    """Gradient steps with halving, until nothing moves."""
    x, b = np.c_[np.ones(len(x)), x], np.zeros(x.shape[1] + 1)

    def value(b):
        z, sign = x @ b, 2 * y - 1
        loss = np.logaddexp(0, z) - z * y if model == "logreg" else np.maximum(1 - sign * z, 0) ** 2
        return c * (w * loss).sum() + 0.5 * (b[1:] ** 2).sum()

    def grad(b):
        z, sign = x @ b, 2 * y - 1
        slope = 1 / (1 + np.exp(-z)) - y if model == "logreg" else -2 * np.maximum(1 - sign * z, 0) * sign
        return c * x.T @ (w * slope) + np.r_[0, b[1:]]

    step = 1.0
    for _ in range(20000):
        g = grad(b)
        if np.abs(g).max() < 1e-8:
            break
        while value(b - step * g) > value(b) - 0.5 * step * (g @ g) and step > 1e-14:
            step /= 2
        b, step = b - step * g, step * 2
    return b


@pytest.mark.parametrize("model,balanced", [("logreg", False), ("logreg", True), ("linsvm", False), ("linsvm", True)])
def test_folds_fitted_together_are_those_fitted_apart(spark, model, balanced):
    rng = np.random.default_rng(3)
    n = 160
    y = (rng.random(n) < 0.3).astype(float)
    x = rng.normal(size=(n, 2)) + y[:, None] * [1.0, 0.4]
    rows = [(i, float(y[i]), float(x[i, 0]), float(x[i, 1])) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, y double, a double, b double")
    fold = np.array([r["f"] for r in df.select("id", F.pmod(F.xxhash64("id"), F.lit(3)).alias("f")).orderBy("id").collect()])
    out = {r["fold"]: r for r in crossval.cross_validate(df, ["a", "b"], "y", "id", 3, 0.5, model, balanced).collect()}
    assert sorted(out) == [-1, 0, 1, 2]
    for k, r in out.items():
        train, test = (fold != k, fold == k) if k >= 0 else (fold >= 0, fold >= 0)
        ones = y[train].sum()
        w = np.where(y[train] > 0, train.sum() / (2 * ones), train.sum() / (2 * (train.sum() - ones))) if balanced else np.ones(train.sum())
        want = plain_fit(x[train], y[train], 0.5, model, w)
        assert np.allclose([r["intercept"], *r["coef"]], want, atol=1e-5)
        z, t = want[0] + x[test] @ want[1:], y[test]
        hit = ((z > 0) & (t > 0)).sum()
        pairs = [(p > q) + 0.5 * (p == q) for p in z[t > 0] for q in z[t == 0]]
        assert r["n"] == test.sum() and abs(r["accuracy"] - ((z > 0) == (t > 0)).mean()) < 1e-9
        assert abs(r["f1"] - 2 * hit / ((z > 0).sum() + t.sum())) < 1e-9 and abs(r["auc"] - np.mean(pairs)) < 1e-9


def test_fusion_with_odd_rows(spark):
    rows = [(i, float(i % 2), None if i % 5 == 0 else float(i % 2) + i % 3 / 10) for i in range(40)] + [(None, 1.0, math.nan), (99, None, 1.0)]
    out = crossval.cross_validate(spark.createDataFrame(rows, "id long, y double, a double"), ["a"], "y", "id", 2).collect()
    assert {r["fold"] for r in out} == {-1, 0, 1} and [r["n"] for r in out if r["fold"] == -1] == [41]
    with pytest.raises(ValueError):
        crossval.cross_validate(spark.createDataFrame([(1, 1.0, 1.0)], "id long, y double, a double"), ["a"], "y", "id", 2)


def test_streams_end_in_a_table_with_late_rows_apart(spark, tmp_path):
    from millrace.streaming import jobs

    for rows in ([("a", 1.0), ("a", 2.0), ("b", 9.0), ("b", None)], [("a", 0.5), ("a", 2.5), ("a", 3.0), ("c", 1.0)]):
        spark.createDataFrame(rows, "k string, t double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = jobs.read_stream(spark, str(tmp_path / "in"), "*.parquet", "k string, t double")
    out = jobs.drain(jobs.merge_close_stream(stream, "k", "t", 1.5, with_late=True), "append", f"file://{tmp_path}/run")
    assert sorted((r["k"], r["kept"], r["late"]) for r in out.collect()) == [("a", 0.5, True), ("a", 1.0, False), ("a", 2.5, False), ("b", 9.0, False), ("c", 1.0, False)]
    (tmp_path / "none").mkdir()
    empty = jobs.read_stream(spark, str(tmp_path / "none"), "*.parquet", "k string, t double")
    assert jobs.drain(jobs.merge_close_stream(empty, "k", "t", 1.5), "append", f"file://{tmp_path}/run2").count() == 0

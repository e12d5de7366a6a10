"""Change points, as-of joins and lag correlations in bounded memory: against plain forms over whole series."""

import itertools
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import changepoint as C
from millrace.operators import series as S


def steps(rng, n, d=2):
    level = np.repeat(rng.normal(size=(n // 20 + 1, d)) * 3, 20, axis=0)[:n]
    return C.standardize(level + rng.normal(scale=0.3, size=(n, d)))


def exhaustive(x, penalty, min_size):
    """The least cost over all segmentations."""
    sums, n = C.kernel_sums(x), len(x)
    best = (np.inf, None)
    for k in range(n // min_size):
        for inner in itertools.combinations(range(min_size, n - min_size + 1), k):
            ends = [*inner, n]
            if all(e - s >= min_size for s, e in zip([0, *ends], ends, strict=False)):
                value = sum(C.cost(sums, s, e) + penalty for s, e in zip([0, *ends], ends, strict=False)) - penalty
                if value < best[0] - 1e-9:
                    best = (value, ends)
    return best


@pytest.mark.parametrize("seed", range(12))
def test_penalised_points_are_the_best_of_all(seed):
    rng = np.random.default_rng(seed)
    n, min_size, penalty = int(rng.integers(8, 15)), int(rng.integers(2, 4)), float(rng.uniform(0.1, 2))
    x = C.standardize(np.repeat(rng.normal(size=(4, 2)) * 2, 4, axis=0)[:n] + rng.normal(scale=0.4, size=(n, 2)))
    ends, sums = C.penalised(x, penalty, min_size), C.kernel_sums(x)
    value = sum(C.cost(sums, s, e) + penalty for s, e in zip([0, *ends], ends, strict=False)) - penalty
    assert abs(value - exhaustive(x, penalty, min_size)[0]) < 1e-9


def plain_breaks(x, breaks, min_size):
    sums, ends = C.kernel_sums(x), [len(x)]
    for _ in range(breaks):
        best = (0.0, -1)
        for s, e in zip([0, *ends], ends, strict=False):
            for m in range(s + min_size, e - min_size + 1):
                gain = C.cost(sums, s, e) - C.cost(sums, s, m) - C.cost(sums, m, e)
                if gain > best[0] + 1e-12:
                    best = (gain, m)
        if best[1] < 0:
            break
        ends = sorted([*ends, best[1]])
    return ends


@pytest.mark.parametrize("n", [4, 30, 200])
def test_breaks_are_those_of_the_whole_matrix(n):
    x = steps(np.random.default_rng(n), n)
    for breaks in (1, 3, 6):
        assert C.with_breaks(x, breaks, 2) == plain_breaks(x, breaks, 2)


def test_the_width_is_the_median_of_all_pairs(monkeypatch):
    rng = np.random.default_rng(1)
    monkeypatch.setattr(C, "CHUNK", 500)
    for x in (rng.normal(size=(101, 3)), rng.integers(0, 3, (64, 1)).astype(float), np.zeros((50, 2)), np.zeros((1, 2)), rng.normal(size=(2, 1))):
        squared = ((x[:, None] - x[None]) ** 2).sum(axis=2)[np.triu_indices(len(x), 1)]
        assert C.median_square(x) == (pytest.approx(np.median(squared), rel=1e-12) if len(squared) else 0.0)


def test_memory_follows_the_number_of_windows():
    x = steps(np.random.default_rng(3), 4000)
    tracemalloc.start()
    ends = C.penalised(x, 2.0, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 100 < len(ends) < 300 and peak < 60 << 20  # the matrix alone would take 128 MB


def test_series_without_a_number_have_no_points(spark):
    df = spark.createDataFrame([(k, i, float(i), float("nan") if k else float(i > 9)) for k in (0, 1) for i in range(20)], "k long, i long, t double, v double")
    assert {(r["k"], r["boundary_idx"]) for r in C.change_points(df, "k", "i", "t", ["v"], penalty=0.5, min_size=3).collect()} == {(0, 10)}


@pytest.mark.parametrize("width", [0.7, 10.0, 1e6])
def test_neighbours_in_blocks_are_those_of_whole_series(spark, width):
    rng = np.random.default_rng(5)
    samples = {k: np.unique(np.round(rng.uniform(-20, 60, n), 1)) for k, n in enumerate((60, 1, 2, 200))}
    rows = [(k, float(t), float(rng.normal())) for k, ts in samples.items() for t in ts]
    points = [(k, float(x)) for k in (*samples, 9) for x in np.arange(-30, 70, 0.5)]
    got = S.neighbours(spark.createDataFrame(rows, "k long, x double, v double"), spark.createDataFrame([(k, x, f"p{x}") for k, x in points], "k long, x double, name string"), "k", width).collect()
    value = {(k, t): v for k, t, v in rows}
    assert len(got) == len(points)
    for r in got:
        ts = samples.get(r["k"], np.zeros(0))
        before, after = ts[ts <= r["x"]], ts[ts >= r["x"]]
        assert r["name"] == f"p{r['x']}"
        assert (r["p"] and tuple(r["p"])) == ((before[-1], value[r["k"], before[-1]]) if len(before) else None)
        assert (r["q"] and tuple(r["q"])) == ((after[0], value[r["k"], after[0]]) if len(after) else None)


def test_grids_from_a_start_are_interp(spark):
    rng = np.random.default_rng(6)
    t = {"hot": np.sort(rng.uniform(0, 9000, 4000)), "two": np.array([10.0, 200.25]), "one": np.array([50.0]), "none": np.zeros(0)}
    f = {k: rng.normal(size=len(v)) for k, v in t.items()}
    rows = [(k, float(a), float(b)) for k in t for a, b in zip(t[k], f[k], strict=True)] + [("none", None, 1.0), ("none", 3.0, None), ("two", None, 9.0)]
    t0, t1, step = 5.25, 9100.25, 2.5
    got = S.interpolate_from(spark.createDataFrame(rows, "k string, t double, v double"), "k", "t", "v", t0, t1, step).collect()
    grid = np.arange(int((t1 + 1e-9 - t0) / step) + 1) * step + t0
    for k in t:
        own = np.array([r["v"] for r in sorted((r for r in got if r["k"] == k), key=lambda r: r["g"])])
        want = np.interp(grid, t[k], f[k], left=np.nan, right=np.nan) if len(t[k]) > 1 else np.full(len(grid), np.nan)
        assert len(own) == len(grid) and np.allclose(own, want, equal_nan=True)
    assert S.interpolate_from(spark.createDataFrame(rows, "k string, t double, v double"), "k", "t", "v", 5.0, 4.0, 1.0).count() == 0


def test_a_hot_series_is_dealt_by_time(spark):
    """Rows of the window over samples: one series, many tasks."""
    hot = spark.range(200_000).select(F.lit("hot").alias("k"), F.col("id").cast("double").alias("x"), F.rand(1).alias("v"))
    grid = spark.range(1000).select(F.lit("hot").alias("k"), (F.col("id") * 199.5).alias("x"))
    out = S.neighbours(hot, grid, "k", 1024.0)
    assert out.filter("p.x <= x and q.x >= x and q.x - p.x <= 1").count() == 1000
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(k" in plan and "_b" in plan


def plain_lags(i, x, y, max_lag):
    at = {a: k for k, a in enumerate(i)}
    out = {}
    for lag in range(-max_lag, max_lag + 1):
        met = [(x[k], y[at[a + lag]]) for a, k in at.items() if a + lag in at]
        if len(met) > 1:
            a, b = np.array(met).T
            out[lag] = (len(met), ((a - a.mean()) * (b - b.mean())).mean() / ((a.std() + 1e-9) * (b.std() + 1e-9)))
    return out


@pytest.mark.parametrize(("max_lag", "block"), [(3, 10), (120, None), (7, 8)])
def test_lags_in_blocks_are_those_of_whole_series(spark, max_lag, block):
    rng = np.random.default_rng(max_lag)
    series = {}
    for k, n in enumerate((2500, 40, 2, 1)):
        i = np.sort(rng.choice(np.arange(-n, 2 * n), n, replace=False))
        x = 1e6 + np.cumsum(rng.normal(size=n))
        series[k] = (i.tolist(), x, np.roll(x, 5) + rng.normal(size=n))
    df = spark.createDataFrame([(k, int(a), float(b), float(c)) for k, (i, x, y) in series.items() for a, b, c in zip(i, x, y, strict=True)], "k long, i long, x double, y double")
    got = {(r["k"], r["lag"]): (r["n"], r["r"]) for r in S.lagged_correlation(df, "k", "i", "x", "y", max_lag, block).collect()}
    want = {(k, lag): v for k, s in series.items() for lag, v in plain_lags(*s, max_lag).items()}
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-6 for k in want)

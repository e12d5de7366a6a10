"""Operators over long series tables (key, order, value). Windows are per series, so a series is the unit of work."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def per_series(key: str):
    return Window.partitionBy(key)


def cmvn(value: str, key: str, epsilon: float = 1e-9) -> Column:
    """(x - mean) / (population std + epsilon)."""
    w = per_series(key)
    return (F.col(value) - F.avg(value).over(w)) / (F.stddev_pop(value).over(w) + epsilon)


def zscore(value: str, key: str, epsilon: float = 1e-9) -> Column:
    """(x - mean) / max(population std, epsilon): another rule for constant series than cmvn."""
    w = per_series(key)
    return (F.col(value) - F.avg(value).over(w)) / F.greatest(F.stddev_pop(value).over(w), F.lit(epsilon))


def demean(value: str, key: str) -> Column:
    return F.col(value) - F.avg(value).over(per_series(key))


def detrend(df: DataFrame, key: str, value: str, idx: str = "idx") -> DataFrame:
    """Adds ``detrended``: the value less its least-squares line over ``idx``; a single value becomes 0."""
    fit = df.groupBy(key).agg(F.regr_slope(value, idx).alias("_slope"), F.avg(value).alias("_my"), F.avg(idx).alias("_mx"))
    line = F.col("_my") + F.coalesce("_slope", F.lit(0.0)) * (F.col(idx) - F.col("_mx"))
    return df.join(fit, key).withColumn("detrended", F.col(value) - line).drop("_slope", "_my", "_mx")


def seconds(ts: str | Column) -> Column:
    """Seconds since 1970 as a double, from a time stamp without zone."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(c.cast("timestamp")).cast("double") / 1e6


def summary(df: DataFrame, key: str, value: str, t: str, nominal: float) -> DataFrame:
    """Per series: n, mean_dev from ``nominal``, std_dev, min, max, slope per minute (null below two samples)."""
    start = df.groupBy(key).agg(F.min(t).alias("_t0"))
    return df.join(start, key).groupBy(key).agg(
        F.count(value).alias("n"), F.avg(F.col(value) - nominal).alias("mean_dev"), F.stddev_pop(value).alias("std_dev"), F.min(value).alias("min_v"), F.max(value).alias("max_v"),
        F.when(F.count(value) > 1, F.regr_slope(F.col(value), F.col(t) - F.col("_t0")) * 60).alias("slope_min"),
    )


def frame_rate(df: DataFrame, key: str, t: str) -> DataFrame:
    """Per series the rate 1 / max(mean step, 1e-6); one sample: a step of 0.01."""
    step = F.when(F.count(t) > 1, (F.max(t) - F.min(t)) / (F.count(t) - 1)).otherwise(F.lit(0.01))
    return df.groupBy(key).agg((1.0 / F.greatest(step, F.lit(1e-6))).alias("fps"))


def frames_of(sec: float, fps: Column) -> Column:
    """max(1, sec * fps rounded half to even)."""
    return F.greatest(F.lit(1), F.bround(F.lit(sec) * fps).cast("long"))


def median_smooth(df: DataFrame, key: str, order: list[str], value: str, size: int) -> DataFrame:
    """Adds ``smoothed``: the median of ``size`` values around each, zeros beyond the ends."""
    h = size // 2
    w = Window.partitionBy(key).orderBy(*order)
    around = F.collect_list(value).over(w.rowsBetween(-h, h))
    padded = F.sort_array(F.concat(around, F.array_repeat(F.lit(0.0), F.lit(size) - F.size(around))))
    return df.withColumn("smoothed", F.element_at(padded, h + 1))


def linear_filter(value: str, key: str, order: list[str], weights: list[float]) -> Column:
    """Weighted sum of neighbours; null where a neighbour is missing."""
    w, h = Window.partitionBy(key).orderBy(*order), len(weights) // 2
    terms = [F.lag(value, -k).over(w) * float(c) if k else F.col(value) * float(c) for k, c in zip(range(-h, h + 1), weights, strict=True) if c]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    # The middle may have no weight: neighbours at both ends tell whether the window is whole.
    return F.when(F.lag(value, h).over(w).isNotNull() & F.lag(value, -h).over(w).isNotNull(), out)


SAVGOL_5 = [-3 / 35, 12 / 35, 17 / 35, 12 / 35, -3 / 35]
DELTA_9 = [k / 60 for k in range(-4, 5)]


def neighbours(samples: DataFrame, grid: DataFrame, key: str, width: float) -> DataFrame:
    """Grid points (key, x and more) with ``p`` and ``q``, the samples (x, v) at or before and at or after each; null where there is none.

    Two-sided as-of by union and window, in blocks of time ``width`` long: a window goes over a series' samples of one block, and
    what lies beyond comes from the first and last samples of other blocks, so a hot series is spread over tasks.
    """
    block = F.floor(F.col("x") / width).alias("_b")
    own = samples.select(key, "x", "v", block)
    ends = own.groupBy(key, "_b").agg(F.min(F.struct("x", "v")).alias("_first"), F.max(F.struct("x", "v")).alias("_last"))
    points = grid.select("*", block)
    by = Window.partitionBy(key).orderBy("_b")  # over blocks, not samples
    every = ends.join(points.select(key, "_b").distinct(), [key, "_b"], "full")
    carried = every.select(
        key, "_b",
        F.last("_last", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.first("_first", ignorenulls=True).over(by.rowsBetween(1, Window.unboundedFollowing)).alias("_after"),
    )
    row = F.struct(*[c for c in grid.columns if c not in (key, "x")]).alias("_grid")
    both = points.select(key, "x", "_b", row).unionByName(own.select(key, "x", "_b", F.struct("x", "v").alias("_sample")), allowMissingColumns=True)
    w, point = Window.partitionBy(key, "_b"), F.col("_grid").isNotNull()
    # Samples come before grid points of the same time, and also count as the ones after them.
    before = F.last("_sample", ignorenulls=True).over(w.orderBy("x", point).rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("_sample", ignorenulls=True).over(w.orderBy("x", ~point).rowsBetween(0, Window.unboundedFollowing))
    seen = both.withColumn("_p", before).withColumn("_q", after).filter(point).join(carried, [key, "_b"])
    return seen.select(key, "x", "_grid.*", F.coalesce("_p", "_before").alias("p"), F.coalesce("_q", "_after").alias("q"))


def _on_line() -> Column:
    slope = F.when(F.col("q.x") > F.col("p.x"), (F.col("q.v") - F.col("p.v")) / (F.col("q.x") - F.col("p.x"))).otherwise(F.lit(0.0))
    return F.col("p.v") + slope * (F.col("x") - F.col("p.x"))


def _clean(df: DataFrame, key: str, t: str, value: str) -> DataFrame:
    """Samples (key, x, v) with a value; of those of one time the least."""
    return df.filter(F.col(value).isNotNull() & F.col(t).isNotNull()).groupBy(key, F.col(t).cast("double").alias("x")).agg(F.min(value).alias("v"))


def interpolate_grid(df: DataFrame, key: str, t: str, value: str, step: int) -> DataFrame:
    """Linear interpolation on multiples of ``step`` seconds between a series' first and last time: key, g, v.

    Grids of several series share their points. A series whose times hold no multiple has no values.
    """
    clean = _clean(df, key, t, value)
    ends = clean.groupBy(key).agg(F.ceil(F.min("x") / step).cast("long").alias("a"), F.floor(F.max("x") / step).cast("long").alias("b")).filter("a <= b")
    grid = ends.select(key, F.explode(F.sequence("a", "b")).alias("g")).select(key, (F.col("g") * step).cast("double").alias("x"), "g")
    return neighbours(clean, grid, key, 1024.0 * step).filter("p IS NOT NULL AND q IS NOT NULL").select(key, "g", _on_line().alias("v"))


def interpolate_from(df: DataFrame, key: str, t: str, value: str, t0: float, t1: float, step: float) -> DataFrame:
    """Linear interpolation of every series on one grid from ``t0`` to ``t1`` (with 1e-9 to spare), ``step`` seconds apart: key, g, x, v.

    Points outside a series' times are NaN, and all are where it has fewer than two.
    """
    n = int(np.floor((t1 + 1e-9 - t0) / step)) + 1
    clean = _clean(df, key, t, value)
    grid = df.select(key).distinct().select(key, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("g") if n > 0 else F.explode(F.array().cast("array<bigint>")).alias("g"))
    grid = grid.withColumn("x", F.lit(float(t0)) + F.col("g") * float(step))
    # Fewer than two samples: there is none on one side of any point, or the same one on both.
    alone = clean.groupBy(key).agg((F.count(F.lit(1)) < 2).alias("_alone"))
    found = neighbours(clean, grid, key, 1024.0 * step).join(alone, key, "left")
    inside = F.col("p").isNotNull() & F.col("q").isNotNull() & ~F.coalesce("_alone", F.lit(True))
    return found.select(key, "g", "x", F.when(inside, _on_line()).otherwise(F.lit(float("nan"))).alias("v"))


def lagged_correlation(pairs: DataFrame, key: str, idx: str, x: str, y: str, max_lag: int, block: int | None = None) -> DataFrame:
    """Correlation of x[i] with y[i + lag] for each lag up to ``max_lag`` either way: key, lag, n, r.

    Each lag is standardised over its own overlap, with 1e-9 added to both deviations. A series is cut into blocks of at least four
    times the largest lag, each with the rows on either side that its lags reach: a row is sent twice at most, a block gives a
    row of moments about its own means for each lag, and those are merged: 48 bytes for each block and lag.
    """
    size = block or max(1024, 4 * max_lag)
    kind = dict(pairs.dtypes)[key]
    lags, names = np.arange(-max_lag, max_lag + 1), ["n", "mx", "my", "xx", "yy", "xy"]

    def moments(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        first = int(group[1]) * size - max_lag
        u, v = np.full(size + 2 * max_lag, np.nan), np.full(size + 2 * max_lag, np.nan)
        at = pdf["_i"].to_numpy() - first
        u[at], v[at] = pdf["_x"], pdf["_y"]
        own, rows = u[max_lag : max_lag + size], []
        for lag in lags.tolist():
            other = v[max_lag + lag : max_lag + lag + size]
            met = ~(np.isnan(own) | np.isnan(other))
            a, b = own[met], other[met]
            if len(a):
                mx, my = a.mean(), b.mean()
                a, b = a - mx, b - my
                rows.append((lag, len(a), mx, my, a @ a, b @ b, a @ b))
        out = pd.DataFrame(rows, columns=["lag", *names])
        out.insert(0, key, pd.Series([group[0]] * len(out), dtype=object))
        return out

    i = F.col(idx).cast("long")
    rows = pairs.select(key, i.alias("_i"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    dealt = rows.withColumn("_b", F.explode(F.sequence(F.floor((F.col("_i") - max_lag) / size), F.floor((F.col("_i") + max_lag) / size))))
    parts = dealt.groupBy(key, "_b").applyInPandas(moments, f"`{key}` {kind}, lag int, n double, mx double, my double, xx double, yy double, xy double")

    def merge(p: Column, q: Column) -> Column:
        n, dx, dy = p["n"] + q["n"], q["mx"] - p["mx"], q["my"] - p["my"]
        share, both = q["n"] / n, p["n"] * q["n"] / n
        return F.struct(n.alias("n"), (p["mx"] + dx * share).alias("mx"), (p["my"] + dy * share).alias("my"), (p["xx"] + q["xx"] + dx * dx * both).alias("xx"), (p["yy"] + q["yy"] + dy * dy * both).alias("yy"), (p["xy"] + q["xy"] + dx * dy * both).alias("xy"))

    none = F.struct(*[F.lit(0.0).alias(c) for c in names])
    whole = parts.groupBy(key, "lag").agg(F.collect_list(F.struct(*names)).alias("_m")).withColumn("_m", F.aggregate("_m", none, merge)).filter("_m.n >= 2")
    spread = lambda c: F.sqrt(F.col(f"_m.{c}") / F.col("_m.n")) + 1e-9
    return whole.select(key, "lag", F.col("_m.n").cast("long").alias("n"), (F.col("_m.xy") / F.col("_m.n") / (spread("xx") * spread("yy"))).alias("r"))


def best_lag(correlations: DataFrame, key: str) -> DataFrame:
    """The lag of the largest r, the least lag among equals; NaN does not count."""
    clean = correlations.filter(~F.isnan("r"))
    return clean.groupBy(key).agg(F.max_by("lag", F.struct(F.round("r", 9), -F.col("lag"))).alias("best_lag"), F.max("r").alias("rho_max"))


def merge_close(df: DataFrame, key: str, t: str, gap: float) -> DataFrame:
    """Greedy: a time is kept if it is at least ``gap`` after the last kept one. One row per series with its kept times.

    A time that comes ``gap`` or more after the one before is kept whatever came earlier, so the times between two such are
    settled by themselves: a task folds one stretch of close times, never a whole series. Null times do not count.
    """
    w = Window.partitionBy(key).orderBy(t)
    far = F.coalesce(F.col(t) - F.lag(t).over(w) >= gap, F.lit(False)).cast("long")
    stretches = df.filter(F.col(t).isNotNull()).select(key, t, far.alias("_far")).withColumn("_stretch", F.sum("_far").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    kept = F.aggregate(F.array_sort(F.collect_list(t)), F.array().cast("array<double>"), lambda acc, x: F.when((F.size(acc) == 0) | (x - F.element_at(acc, -1) >= gap), F.concat(acc, F.array(x))).otherwise(acc))
    folded = stretches.groupBy(key, "_stretch").agg(kept.alias("_kept"))
    settled = folded.groupBy(key).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_stretch", "_kept"))), lambda x: x["_kept"])).alias("_kept"))
    return df.select(key).distinct().join(settled.withColumnRenamed(key, "_key"), F.col(key).eqNullSafe(F.col("_key")), "left").select(key, F.coalesce("_kept", F.array().cast("array<double>")).alias("kept"))


def first_per_time(df: DataFrame, key: list[str], seq: str) -> DataFrame:
    """Drops rows that repeat a key, keeping the first by ``seq``."""
    w = Window.partitionBy(*key).orderBy(seq)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")



"""Smoothing over a stretch of seconds: each series has its own window, and is cut into blocks with a margin, so none is one task."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Samples of a block; a longer window makes longer blocks.
BLOCK = 1024


def placed(df: DataFrame, key: str, t: str, ties: list[str]) -> DataFrame:
    """Adds ``idx``, a row's position in its series by time and ``ties``, ``n``, the rows of the series, and ``step``, the mean time between them.

    Positions come in two steps, within stretches of time that hold some thousand samples at the series' mean rate, and from the
    counts of the stretches before. Rows without a time go. Null keys are one series.
    """
    rows = df.filter(F.col(t).isNotNull())
    ends = rows.groupBy(F.col(key).alias("_key")).agg(F.min(t).alias("_t0"), F.max(t).alias("_t1"), F.count(F.lit(1)).alias("n"))
    ends = ends.withColumn("step", F.when(F.col("n") > 1, (F.col("_t1") - F.col("_t0")) / (F.col("n") - 1)).otherwise(F.lit(0.01)))
    cut = F.floor((F.col(t) - F.col("_t0")) / F.greatest(F.col("step") * BLOCK, F.lit(1e-9))).cast("long")
    blocks = rows.join(ends, F.col(key).eqNullSafe(F.col("_key"))).withColumn("_b", cut).drop("_key")
    counts = blocks.groupBy(F.col(key).alias("_key"), F.col("_b").alias("_block")).agg(F.count(F.lit(1)).alias("_n"))
    up = Window.partitionBy("_key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # over stretches, not samples
    before = counts.select("_key", "_block", F.coalesce(F.sum("_n").over(up), F.lit(0)).alias("_before"))
    ranked = blocks.withColumn("_rank", F.row_number().over(Window.partitionBy(key, "_b").orderBy(t, *ties)))
    found = ranked.join(before, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_b") == F.col("_block")))
    return found.select(*df.columns, (F.col("_before") + F.col("_rank") - 1).alias("idx"), "n", "step")


@lru_cache(maxsize=64)
def coefficients(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the places of a window, and the matrix that takes its values to the fitted polynomial: of degree a fifth of the size, 1 to 3."""
    powers = np.vander(np.arange(size) - size // 2, min(3, max(1, size // 5)) + 1, increasing=True).astype(float)
    return powers, np.linalg.pinv(powers)


def fitted(x: np.ndarray, first: int, begin: int, end: int, n: int, size: int) -> np.ndarray:
    """Smoothed values at the places begin to end of a series of n, from ``x``, its values from place ``first`` on.

    Inside, the fit of the window around; the first and last half window come from one fit each.
    """
    half, (powers, fit) = size // 2, coefficients(size)
    if n < size:
        return x[begin - first : end - first]
    out = np.empty(end - begin)
    low, high = max(begin, half), min(end, n - half)
    if low < high:
        out[low - begin : high - begin] = np.lib.stride_tricks.sliding_window_view(x[low - half - first : high + half - first], size) @ (powers[half] @ fit)
    if begin < half:
        out[: min(half, end) - begin] = powers[begin : min(half, end)] @ (fit @ x[:size])
    if end > n - half:
        at = max(begin, n - half)
        out[at - begin :] = powers[at - n + size : end - n + size] @ (fit @ x[n - size - first : n - first])
    return out


def medians(x: np.ndarray, first: int, begin: int, end: int, n: int, size: int) -> np.ndarray:
    """The median around each place, zeros beyond the ends of the series."""
    half = size // 2
    low, high = max(begin - half, 0), min(end + half, n)
    padded = np.pad(x[low - first : high - first], (low - begin + half, end + half - high))
    return np.median(np.lib.stride_tricks.sliding_window_view(padded, size), axis=1)


def smooth_seconds(df: DataFrame, key: str, t: str, value: str, seconds: float, method: str = "savgol", ties: list[str] | None = None) -> DataFrame:
    """Adds ``smoothed``: every series smoothed over ``seconds`` at its own mean rate; the window is an odd number of samples, 3 at least.

    ``savgol``: a polynomial fitted to each window. A series shorter than its window, or with a value that is null or not finite, stays
    as it is. ``median``: zeros beyond the ends; a null counts as NaN. Without seconds the series stays as it is. Rows without a time go;
    a column ``smoothed`` of the input is replaced. Samples of one time stand in the order of ``ties``.
    A sample is copied to at most two blocks beside its own.
    """
    if method not in ("savgol", "median"):
        raise ValueError(f"unknown smoothing {method}: savgol or median")
    number = F.col(value).cast("double")
    if seconds <= 0:
        return df.filter(F.col(t).isNotNull()).withColumn("smoothed", number)
    size = F.greatest(F.lit(3), F.bround(F.lit(float(seconds)) / F.greatest(F.col("step"), F.lit(1e-6))).cast("long"))
    packed = df.select(F.struct(*[c for c in df.columns if c != "smoothed"]).alias("row"), F.col(key).alias("k"), F.col(t).alias("t"), number.alias("x"), *[F.col(c).alias(f"tie{i}") for i, c in enumerate(ties or [])])
    rows = placed(packed, "k", "t", [c for c in packed.columns if c.startswith("tie")]).select("row", "k", "idx", "n", "x", (size + F.when(size % 2 == 0, 1).otherwise(0)).alias("w"))
    rows = rows.withColumn("len", F.greatest(F.lit(BLOCK), "w")).withColumn("own", F.floor(F.col("idx") / F.col("len")))
    block = F.sequence(F.floor(F.greatest(F.col("idx") - F.col("w") + 1, F.lit(0)) / F.col("len")), F.floor(F.least(F.col("idx") + F.col("w") - 1, F.col("n") - 1) / F.col("len")))
    spread = rows.withColumn("b", F.explode(block))
    item = F.struct("idx", "x", F.when(F.col("b") == F.col("own"), F.col("row")).alias("row"))
    blocks = spread.groupBy("k", "b", "n", "w", "len").agg(F.array_sort(F.collect_list(item)).alias("items"))  # at most three blocks of samples

    work = fitted if method == "savgol" else medians

    @F.pandas_udf("array<double>")
    def smooth(xs: pd.Series, first: pd.Series, b: pd.Series, n: pd.Series, w: pd.Series, length: pd.Series) -> pd.Series:
        return pd.Series([work(np.asarray(x, float), f, i * m, min(c, (i + 1) * m), c, s) for x, f, i, c, s, m in zip(xs, first, b, n, w, length, strict=True)])

    values = F.transform("items", lambda i: i["x"])
    made = blocks.withColumn("y", smooth(values, F.get("items", 0)["idx"], F.col("b"), F.col("n"), F.col("w"), F.col("len")))
    own = F.filter("items", lambda i: i["row"].isNotNull())
    out = made.select("k", F.explode(F.arrays_zip(own.alias("i"), F.col("y"))).alias("z")).select("k", "z.i.row", "z.i.x", "z.y")
    if method == "median":
        return out.select("row.*", F.col("y").alias("smoothed"))
    odd = rows.filter(F.col("x").isNull() | F.isnan("x") | (F.abs("x") == float("inf"))).select(F.col("k").alias("_k"), F.lit(True).alias("_odd")).distinct()
    return out.join(odd, F.col("k").eqNullSafe(F.col("_k")), "left").select("row.*", F.when(F.col("_odd"), F.col("x")).otherwise(F.col("y")).alias("smoothed"))

"""Sliding count windows over ordered series, in long form (one row for each sample)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_index(df: DataFrame, key: str, order: list[str], name: str = "idx") -> DataFrame:
    """Adds each row's position in its series, from 0."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn(name, (F.row_number().over(w) - 1).cast("long"))


def sliding_windows(indexed: DataFrame, key: str, win: int | Column, hop: int | Column, idx: str = "idx") -> DataFrame:
    """One row for each sample and window that holds it, with ``window_idx``. Length and step may be columns that are one value per series.

    Only complete windows count; a series shorter than ``win`` has the single window 0 over all of it. A sample is in at
    most ceil(win / hop) windows, so the rows grow by that factor at most.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    i = F.col(idx)
    win, hop = (c if isinstance(c, Column) else F.lit(c) for c in (win, hop))
    last_window = F.greatest(F.lit(0), F.floor((F.col("_n") - win) / hop))
    first = F.greatest(F.lit(0), F.ceil((i - win + 1) / hop))
    last = F.least(F.floor(i / hop), last_window)
    held = indexed.withColumn("_n", n).withColumn("_first", first.cast("long")).withColumn("_last", last.cast("long"))
    return (
        held.filter(F.col("_first") <= F.col("_last"))
        .withColumn("window_idx", F.explode(F.sequence("_first", "_last")))
        .drop("_n", "_first", "_last")
    )


def window_stats(df: DataFrame, key: str, order: list[str], value: str, win: int, hop: int, aggs: list[Column]) -> DataFrame:
    """Aggregates each window of each series; ``aggs`` may use the columns of ``df`` and ``idx``."""
    windows = sliding_windows(with_index(df.filter(F.col(value).isNotNull()), key, order), key, win, hop)
    return windows.groupBy(key, "window_idx").agg(*aggs)

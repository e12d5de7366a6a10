"""Structured Streaming forms: windowed counts with a watermark, appending extraction, and greedy gap merging with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.operators.extract import extract_features


def read_stream(spark: SparkSession, folder: str, names: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A stream of the folder's Parquet files whose names match."""
    return spark.readStream.schema(schema).option("pathGlobFilter", names).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def window_counts(events: DataFrame, ts: str, key: str, size: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Counts per window and key; rows later than the watermark are dropped and their state is freed."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, size).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("w"), key, "n")


def extract_stream(clips: DataFrame, configs: list, out: str, checkpoint: str):
    """Extracts features of new clips and appends them to the store; files and offsets are committed once."""
    return extract_features(clips, configs).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).partitionBy("cfg_hash").trigger(availableNow=True).start()


def merge_close_stream(events: DataFrame, key: str, t: str, gap: float, with_late: bool = False) -> DataFrame:
    """(key, kept): times that are at least ``gap`` after the last kept one of their key; the state of a key is that time alone.

    Times of a batch are sorted first. A time ahead of one that an earlier batch kept can change nothing any more: it goes, or
    with ``with_late`` comes out with a further column ``late`` set, for the caller to store apart. Null times do not count.
    """
    kind = dict(events.dtypes)[key]

    def keep(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = before = state.get[0] if state.exists else float("-inf")
        kept = []
        for x in sorted(x for f in frames for x in f[t]):
            if x < before or x - last >= gap:
                kept.append((group[0], x, x < before))
                last = max(last, x)
        if last > float("-inf"):
            state.update((last,))
        if kept:
            yield pd.DataFrame(kept, columns=[key, "kept", "late"])

    named = events.filter(F.col(t).isNotNull()).select(key, t).groupBy(key)
    out = named.applyInPandasWithState(keep, f"{key} {kind}, kept double, late boolean", "last double", "append", GroupStateTimeout.NoTimeout)
    return out if with_late else out.filter("NOT late").drop("late")


def drain(stream: DataFrame, mode: str, folder: str) -> DataFrame:
    """A bounded stream run to its end; what its batches gave, read back from ``folder`` with the column ``batch``.

    A batch is written as Parquet under its number and overwritten if it is run again, so each counts once. Nothing passes through the driver.
    """
    spark, out = stream.sparkSession, f"{folder.rstrip('/')}/out"
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{out}/batch=-1")  # a stream without rows has a table too

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder.rstrip('/')}/offsets").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)

"""Events as spans (s, e) of a key: groups that overlap one through another, and suppression by overlap, with labels and sources united."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def overlap_groups(events: DataFrame, key: str, width: float) -> DataFrame:
    """Adds ``grp``, from 0 within a key: a span belongs to the group before if it starts ahead of the furthest end so far.

    Spans that only touch are apart. Rows without a key, a start or an end go; an end ahead of its start counts as the start. The running
    maximum and the running number come in two steps, within stretches of ``width`` of starts and over the stretches before,
    so a long key is spread over tasks.
    """
    rows = events.filter(F.col(key).isNotNull() & F.col("s").isNotNull() & F.col("e").isNotNull())
    rows = rows.withColumn("_e", F.greatest("s", "e")).withColumn("_b", F.floor(F.col("s") / width).cast("long"))
    up = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # over stretches, not spans
    reach = rows.groupBy(key, "_b").agg(F.max("_e").alias("_far")).select(key, "_b", F.max("_far").over(up).alias("_carried"))
    inside = Window.partitionBy(key, "_b").orderBy("s", "_e").rowsBetween(Window.unboundedPreceding, -1)
    far = F.greatest(F.max("_e").over(inside), F.col("_carried"))
    marked = rows.join(reach, [key, "_b"]).withColumn("_new", F.coalesce(F.col("s") >= far, F.lit(True)).cast("long"))
    starts = marked.groupBy(key, "_b").agg(F.sum("_new").alias("_starts")).select(key, "_b", F.coalesce(F.sum("_starts").over(up), F.lit(0)).alias("_before"))
    # Spans of one start and end are in one group, so rows in between may stand in any order.
    number = F.col("_before") + F.sum("_new").over(Window.partitionBy(key, "_b").orderBy("s", "_e", F.desc("_new")).rowsBetween(Window.unboundedPreceding, 0)) - 1
    return marked.join(starts, [key, "_b"]).select(*events.columns, number.alias("grp"))


def fuse_groups(events: DataFrame, key: str, width: float) -> DataFrame:
    """One row per group of overlapping events (key, id, s, e, label, score, sources): its span, labels and sources once each, the best score and
    the id that has it (the earliest, then least, of equals), and how many events it holds. Partial aggregates only; null scores count as least."""
    grouped = overlap_groups(events, key, width)
    best = F.max_by("id", F.struct(F.col("score").isNotNull(), "score", -F.col("s"), -F.col("id")))
    return grouped.groupBy(key, "grp").agg(
        F.min("s").alias("s"), F.max(F.greatest("s", "e")).alias("e"), F.max("score").alias("score"), best.alias("best"), F.count(F.lit(1)).alias("n"),
        F.sort_array(F.collect_set("label")).alias("labels"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("sources")))).alias("sources"),
    )


def suppress(events: DataFrame, key: str, max_iou: float = 0.5) -> DataFrame:
    """Events (key, id, s, e, score, sources) that stay: best score first, one goes if its overlap with the last one kept is ``max_iou`` of
    their union or more, and leaves its sources to it. Rows without key, span or score go.

    Rows are sorted within partitions by key and folded as they stream by: a task holds one kept event, never a key's list. A key is one task.
    """
    kinds = dict(events.dtypes)
    schema = ", ".join(f"{name} {kinds[c]}" for name, c in zip(("k", "id", "s", "e", "score", "sources"), (key, "id", "s", "e", "score", "sources"), strict=True))
    rows = events.select(F.col(key).alias("k"), "id", "s", "e", "score", F.coalesce("sources", F.array().cast(kinds["sources"])).alias("sources")).dropna(subset=["k", "s", "e", "score"])

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: list | None = None
        for pdf in frames:
            kept = []
            for k, i, s, e, score, sources in pdf.itertuples(index=False):
                if last is not None and last[0] == k:
                    both = max(0.0, min(last[3], e) - max(last[2], s))
                    union = (last[3] - last[2]) + (e - s) - both
                    if union > 0 and both / union >= max_iou:
                        last[5].update(sources)
                        continue
                if last is not None:
                    kept.append((*last[:5], sorted(last[5])))
                last = [k, i, s, e, score, set(sources)]
            yield pd.DataFrame(kept, columns=list(pdf.columns))
        if last is not None:
            yield pd.DataFrame([(*last[:5], sorted(last[5]))], columns=["k", "id", "s", "e", "score", "sources"])

    ordered = rows.repartition("k").sortWithinPartitions("k", F.desc("score"), "s", "e", "id")
    return ordered.mapInPandas(fold, schema).withColumnRenamed("k", key)

"""Manifest operators: path resolution by prioritised keys, unions, majority filters, coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T


#: Starts the index keys that are whole paths; names and stems of files hold no line feed.
WHOLE = "\n"


def path_index(files: DataFrame, path: str) -> DataFrame:
    """(key, path) for each file's name and stem in lower case, and for the path itself; of files that share a key the least path."""
    keys = F.array_distinct(F.array(T.base_name(F.col(path)), T.stem(F.col(path)), F.concat(F.lit(WHOLE), F.col(path))))
    return files.select(F.explode(keys).alias("key"), F.col(path).alias("path")).groupBy("key").agg(F.min("path").alias("path"))


def _tries(token: Column, base: str | None) -> list[Column]:
    """Index keys that a token may mean, likeliest first; null where one does not apply."""
    t = F.lower(F.trim(token))
    places = [base.rstrip("/"), base.rstrip("/").rpartition("/")[0]] if base else []
    under = [F.when(token.rlike(r"[/\\]"), F.concat(F.lit(f"{WHOLE}{place}/"), token)) for place in places]
    return [*under, t, F.when(~t.endswith(".wav"), F.concat(t, F.lit(".wav")))]


def resolve(tokens: DataFrame, token: str, index: DataFrame, base: str | None = None, fallback: str | None = None) -> DataFrame:
    """Adds ``path`` to the tokens that an index key meets, by priority: a token with a folder under ``base``, then under the
    folder above it, the token as a name or stem, the token with .wav; then the same of the column ``fallback``.

    Paths are compared as written: ``..`` and links are not followed. One equi-join on exploded (priority, key), whatever the
    number of priorities.
    """
    tries = [c for name in (token, fallback) if name for c in _tries(F.col(name), base)]
    keyed = tokens.withColumn("_try", F.explode(F.array(*[F.struct(F.lit(k).alias("p"), c.alias("key")) for k, c in enumerate(tries)])))
    hits = keyed.join(index.withColumnRenamed("key", "_key"), F.col("_try.key") == F.col("_key"))
    return hits.groupBy(*tokens.columns).agg(F.min_by("path", "_try.p").alias("path"))


def union_distinct(parts: list[DataFrame], columns: list[str]) -> DataFrame:
    """All rows of all parts, cut to ``columns``, each once."""
    return reduce(DataFrame.unionByName, [p.select(*columns) for p in parts]).dropDuplicates()


def keep_majority(df: DataFrame, key: str, seq: str) -> DataFrame:
    """Rows with the commonest ``key``; among equals the one seen first by ``seq``."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.min(seq).alias("_first"))
    best = counts.agg(F.max_by(key, F.struct("_n", (-F.col("_first")).alias("m"))).alias("_best"))
    return df.join(F.broadcast(best), F.col(key) == F.col("_best")).drop("_best")  # one row


def coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: total, used (with a match) and missing rows of ``left``."""
    has = right.select(key).distinct().withColumn("_has", F.lit(True))
    return left.join(has, key, "left").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("_has")).alias("used"), F.count_if(F.col("_has").isNull()).alias("missing"))


def interval_overlaps(a: DataFrame, b: DataFrame, key: str, bucket: float) -> DataFrame:
    """Pairs of spans (s, e) of one key that overlap: an equi-join on the time buckets both touch, each pair taken once."""
    cut = lambda c: F.floor(F.col(c) / bucket).cast("long")
    x = a.withColumn("_b", F.explode(F.sequence(cut("s"), cut("e"))))
    y = b.select(key, F.col("id").alias("id2"), F.col("s").alias("s2"), F.col("e").alias("e2")).withColumn("_b", F.explode(F.sequence(F.floor(F.col("s2") / bucket).cast("long"), F.floor(F.col("e2") / bucket).cast("long"))))
    met = x.join(y, [key, "_b"]).filter((F.col("s") < F.col("e2")) & (F.col("s2") < F.col("e")))
    # The bucket of the overlap's start is touched by both: only there the pair is taken.
    return met.filter(F.col("_b") == F.floor(F.greatest("s", "s2") / bucket)).drop("_b")


def nms(events: DataFrame, key: str, max_iou: float = 0.5) -> DataFrame:
    """Per key the events (s, e, score) that stay: best score first, an event goes if its overlap with the last one kept is too large."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("m"), F.col("s").alias("s"), F.col("e").alias("e"), F.col("id").alias("id"))))

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        both = F.greatest(F.lit(0.0), F.least(last["e"], x["e"]) - F.greatest(last["s"], x["s"]))
        iou = both / F.greatest(F.lit(1e-9), (last["e"] - last["s"]) + (x["e"] - x["s"]) - both)
        return F.when((F.size(acc) == 0) | (iou < max_iou), F.concat(acc, F.array(x))).otherwise(acc)

    kind = "array<struct<m:double,s:double,e:double,id:bigint>>"
    return events.groupBy(key).agg(F.aggregate(ordered.cast(kind), F.array().cast(kind), step).alias("kept"))

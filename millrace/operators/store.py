"""Scan of the feature store for a list of clips: rows that can be used, and counters of the rest from the same pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from millrace.functions import arrays as A


def scan(clips: DataFrame, store: DataFrame, dim: int = 0, cfg_hash: str = "") -> tuple[DataFrame, Observation]:
    """Clips (path and more) with their ``vector`` and ``cfg_hash`` of the store (path, vector, meta), and the counters of the scan.

    A clip that the store lacks is missing, one without a vector is bad, and one of another length than ``dim`` (0: any) is of
    a wrong dimension: these go. Meta is JSON text; where it is malformed or null it says nothing. A hash other than ``cfg_hash`` is counted,
    but the row stays. NaN becomes 0 and infinities 1e6. The store holds a path once.

    The counters (``total missing bad wrong_dim other_hash used``) are there once an action over the rows has ended; they are counted
    in the scan itself, not in a second pass.
    """
    held = store.select(F.col("path").alias("_path"), F.col("vector"), F.coalesce(F.from_json("meta", "cfg_hash string")["cfg_hash"], F.lit("")).alias("cfg_hash"))
    state = F.when(F.col("_path").isNull(), "missing").when(F.col("vector").isNull(), "bad").when((F.lit(dim) > 0) & (F.size("vector") != dim), "wrong_dim").otherwise("used")
    joined = clips.join(held, F.col("path") == F.col("_path"), "left").withColumn("_state", state)
    other = (F.col("_state") == "used") & (F.col("cfg_hash") != "") & F.lit(cfg_hash != "") & (F.col("cfg_hash") != cfg_hash)
    seen = Observation()
    counters = [F.count_if(F.col("_state") == name).alias(name) for name in ("missing", "bad", "wrong_dim", "used")]
    watched = joined.observe(seen, F.count(F.lit(1)).alias("total"), *counters, F.count_if(other).alias("other_hash"))
    clean = A.sanitize(F.transform("vector", lambda x: x.cast("double")))
    return watched.filter("_state = 'used'").select(*clips.columns, clean.alias("vector"), "cfg_hash"), seen

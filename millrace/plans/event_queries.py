"""Queries over events as spans, smoothing by seconds, the scan of a feature store, and cross-validated fusion."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import arrays as A
from millrace.operators import crossval, overlaps, smoothing, store
from millrace.plans.series_queries import E, events, r6, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None):
    """Registers a function under its name, with its oracle."""

    def add(job):
        QUERIES[job.__name__] = job
        if oracle:
            ORACLES[job.__name__] = oracle
        return job

    return add


#: Samples with position, length and the window of their series: an odd number of samples in 600,000 seconds at its mean rate.
PLACED = f"""WITH s AS (SELECT user_id, event_id, value, {E} AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE value IS NOT NULL),
     r AS (SELECT user_id, greatest(3, round_even(600000 / greatest(CASE WHEN count(*) > 1 THEN (max(t) - min(t)) / (count(*) - 1) ELSE 0.01 END, 1e-6), 0)::BIGINT) AS w FROM s GROUP BY user_id),
     p AS (SELECT s.*, w + (1 - w % 2) AS w, (w + (1 - w % 2)) // 2 AS h FROM s JOIN r USING (user_id))"""

#: The fit in orthogonal polynomials over the places of a window: constant, line, square and cube.
FITTED = PLACED + """,
     a AS (SELECT *, least(3, greatest(1, w // 5)) AS deg, least(greatest(idx - h, 0), n - w) AS a, ((w * w - 1) / 12.0)::DOUBLE AS c2, ((3 * w * w - 7) / 20.0)::DOUBLE AS c3 FROM p),
     m AS (SELECT a.user_id, a.event_id, any_value(a.value) AS v, any_value(a.n) AS n, any_value(a.w)::DOUBLE AS w, any_value(a.deg) AS deg, any_value(a.idx - a.a - a.h)::DOUBLE AS u, any_value(a.c2) AS c2, any_value(a.c3) AS c3,
                  sum(b.value) AS s0, sum(b.value * (b.idx - a.a - a.h)) AS s1, sum(b.value * ((b.idx - a.a - a.h) ** 2 - a.c2)) AS s2, sum(b.value * ((b.idx - a.a - a.h) ** 3 - a.c3 * (b.idx - a.a - a.h))) AS s3
           FROM a LEFT JOIN s b ON b.user_id = a.user_id AND b.idx BETWEEN a.a AND a.a + a.w - 1 AND a.a >= 0 GROUP BY a.user_id, a.event_id)
SELECT user_id, event_id, round(CASE WHEN n < w THEN v ELSE s0 / w + u * s1 * 12 / (w * (w * w - 1))
       + CASE WHEN deg >= 2 THEN (u * u - c2) * s2 * 180 / (w * (w * w - 1) * (w * w - 4)) ELSE 0 END
       + CASE WHEN deg >= 3 THEN (u * u * u - c3 * u) * s3 * 2800 / (w * (w * w - 1) * (w * w - 4) * (w * w - 9)) ELSE 0 END END, 6)::DOUBLE AS v FROM m"""


def valued(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).filter("value IS NOT NULL").select("user_id", "event_id", "t", "value")


@query(FITTED)
def smooth_by_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return smoothing.smooth_seconds(valued(spark, sf_dir), "user_id", "t", "value", 600_000.0, ties=["event_id"]).select("user_id", "event_id", r6("smoothed", "v"))


@query(PLACED + """, o AS (SELECT a.user_id, a.event_id, list(b.value) AS around, any_value(a.w) AS w FROM p a JOIN s b ON b.user_id = a.user_id AND b.idx BETWEEN a.idx - a.h AND a.idx + a.h GROUP BY a.user_id, a.event_id)
SELECT user_id, event_id, round(list_sort(list_concat(around, list_transform(range(w - len(around)), lambda x: 0.0::DOUBLE)))[w // 2 + 1], 6)::DOUBLE AS v FROM o""")
def median_by_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return smoothing.smooth_seconds(valued(spark, sf_dir), "user_id", "t", "value", 600_000.0, "median", ["event_id"]).select("user_id", "event_id", r6("smoothed", "v"))


def spans(spark: SparkSession, sf_dir: str, seconds: int) -> DataFrame:
    e = events(spark, sf_dir).filter("value IS NOT NULL")
    return e.select("user_id", F.col("event_id").alias("id"), F.col("t").alias("s"), (F.col("t") + seconds).alias("e"), F.col("event_type").alias("label"), F.col("value").alias("score"), F.array(F.concat(F.lit("d"), (F.col("event_id") % 3).cast("string"))).alias("sources"))


SPANS = f"SELECT user_id, event_id AS id, {E} AS s, {E} + {{}} AS e, event_type AS label, value AS score, 'd' || event_id % 3 AS src FROM events WHERE value IS NOT NULL"


@query(f"""WITH x AS ({SPANS.format(30000)}),
     m AS (SELECT *, CASE WHEN s < max(e) OVER (PARTITION BY user_id ORDER BY s, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM x),
     g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY s, e, id) - 1 AS grp FROM m)
SELECT user_id, grp::BIGINT AS grp, round(min(s), 3)::DOUBLE AS s, round(max(e), 3)::DOUBLE AS e, round(max(score), 6)::DOUBLE AS score, (list(id ORDER BY score DESC, s, id))[1] AS best, count(*) AS n, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, string_agg(DISTINCT src, ',' ORDER BY src) AS sources
FROM g GROUP BY user_id, grp""")
def event_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = overlaps.fuse_groups(spans(spark, sf_dir, 30_000), "user_id", 86_400.0)
    return g.select("user_id", "grp", F.round("s", 3).alias("s"), F.round("e", 3).alias("e"), r6("score", "score"), "best", "n", F.array_join("labels", ",").alias("labels"), F.array_join("sources", ",").alias("sources"))


#: Each event with the kept one that it belongs to, by steps over the order of scores.
SUPPRESSED = f"""WITH RECURSIVE x AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, s, e, id) AS rk FROM ({SPANS})),
     f AS (SELECT user_id, rk, id, s, e, src FROM x WHERE rk = 1 UNION ALL
           SELECT y.user_id, y.rk, CASE WHEN y.apart THEN y.id ELSE y.fid END, CASE WHEN y.apart THEN y.s ELSE y.fs END, CASE WHEN y.apart THEN y.e ELSE y.fe END, y.src
           FROM (SELECT x.*, f.id AS fid, f.s AS fs, f.e AS fe, greatest(0, least(f.e, x.e) - greatest(f.s, x.s)) / ((f.e - f.s) + (x.e - x.s) - greatest(0, least(f.e, x.e) - greatest(f.s, x.s))) < 0.5 AS apart
                 FROM f JOIN x ON x.user_id = f.user_id AND x.rk = f.rk + 1) y)
"""


@query(SUPPRESSED.replace("{}", "432000") + "SELECT user_id, id, string_agg(DISTINCT src, ',' ORDER BY src) AS sources FROM f GROUP BY user_id, id")
def event_nms_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps.suppress(spans(spark, sf_dir, 432_000), "user_id").select("user_id", "id", F.array_join("sources", ",").alias("sources"))


ORACLES["event_nms_fusion"] = SUPPRESSED.replace("{}", "7200") + "SELECT user_id, count(DISTINCT id) AS n_kept, (list(id ORDER BY rk))[1] AS best FROM f GROUP BY user_id"


@query("""SELECT count(*) AS total, count(*) FILTER (vec_id % 17 = 0) AS missing, count(*) FILTER (vec_id % 17 <> 0 AND vec_id % 13 = 0) AS bad, count(*) FILTER (vec_id % 17 <> 0 AND vec_id % 13 <> 0 AND vec_id % 11 = 0) AS wrong_dim,
       count(*) FILTER (vec_id % 17 <> 0 AND vec_id % 13 <> 0 AND vec_id % 11 <> 0 AND vec_id % 5 <> 0 AND vec_id % 7 = 0) AS other_hash, count(*) FILTER (vec_id % 17 <> 0 AND vec_id % 13 <> 0 AND vec_id % 11 <> 0) AS used,
       round(sum(CASE WHEN vec_id % 17 <> 0 AND vec_id % 13 <> 0 AND vec_id % 11 <> 0 THEN list_sum(embedding::DOUBLE[]) END), 4)::DOUBLE AS checksum FROM embeddings""")
def store_scan_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings as clips, against a store that lacks some and holds others without a vector, too short, with another hash or broken meta."""
    name, i = F.concat(F.lit("clip/"), "vec_id"), F.col("vec_id")
    e = table(spark, sf_dir, "embeddings").withColumn("path", name)
    meta = F.when(i % 5 == 0, "{broken").otherwise(F.concat(F.lit('{"cfg_hash": "'), F.when(i % 7 == 0, "old").otherwise("new"), F.lit('"}')))
    vector = F.when(i % 13 != 0, F.when(i % 11 == 0, F.slice("embedding", 1, 60)).otherwise(F.col("embedding")))
    rows, seen = store.scan(e.select("path"), e.filter(i % 17 != 0).select("path", vector.alias("vector"), meta.alias("meta")), 64, "new")
    base = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='millrace-')}"
    out = f"{base.rstrip('/')}/scan-{uuid.uuid4().hex}"
    rows.write.parquet(out)
    counters = [F.lit(seen.get[c]).cast("long").alias(c) for c in ("total", "missing", "bad", "wrong_dim", "other_hash", "used")]
    return spark.read.parquet(out).agg(F.round(F.sum(A.total(F.col("vector"))), 4).alias("checksum")).select(*counters, "checksum")


@query(None)
def fusion_cross_validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four heads, each the mean of a quarter of an embedding, fused to tell labels below 5 from the others."""
    heads = [f"head{i}" for i in range(4)]
    v = A.doubles("embedding")
    scores = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") < 5).cast("int").alias("label"), *[(A.total(F.slice(v, 16 * i + 1, 16)) / 16).alias(h) for i, h in enumerate(heads)])
    out = crossval.cross_validate(scores, heads, "label", "vec_id")
    return out.select("fold", "n", r6("accuracy", "accuracy"), r6("f1", "f1"), r6("auc", "auc"), r6("intercept", "intercept"), F.array_join(F.transform("coef", lambda x: F.round(x, 6).cast("string")), ",").alias("coef"))

"""Queries from samples to features: framewise spectra as joins and sums, recursive filters over blocks, audio files read in ranges.

Embeddings stand for recordings: 64 samples each, frames of 16 samples, 8 apart.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import arrays as A
from millrace.functions.recursion import band_sections, cascade
from millrace.operators import frames as X
from millrace.operators import jobs
from millrace.plans.series_queries import LONG, r6, waves
from millrace.sources import wav

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
SR, N_FFT, HOP, N_MELS, N_MFCC = 16000, 16, 8, 5, 4
#: A hum of 60 Hz in recordings of 400 samples a second, in a band of 40 Hz.
HUM_SR, LOW, HIGH, ORDER = 400, 40 / 200, 80 / 200, 2


def query(oracle: str | None = None):
    def add(job):
        QUERIES[job.__name__] = job
        if oracle:
            ORACLES[job.__name__] = oracle
        return job

    return add


def recordings(spark: SparkSession, sf_dir: str, sr: int = SR, size: int = 24) -> DataFrame:
    """Embeddings in blocks that are no multiple of a frame."""
    return X.blocks_of(waves(spark, sf_dir), "vec_id", sr, size=size)


#: Everything from its formula: frames by place, the Fourier sum, triangles on the mel scale, the cosine basis.
SPECTRA = (
    LONG
    + f""", x AS (SELECT vec_id, frame, k, coalesce(v, 0) AS v FROM (SELECT DISTINCT vec_id FROM l), (SELECT unnest(range(9)) AS frame), (SELECT unnest(range({N_FFT})) AS k)
          LEFT JOIN (SELECT vec_id AS vid, i, v FROM l) ON vid = vec_id AND i = frame * {HOP} + k - {N_FFT // 2}),
     h AS (SELECT *, v * (0.5 - 0.5 * cos(2 * pi() * k / {N_FFT})) AS s FROM x),
     d AS (SELECT vec_id, frame, bin, pow(sum(s * cos(2 * pi() * bin * k / {N_FFT})), 2) + pow(sum(s * sin(2 * pi() * bin * k / {N_FFT})), 2) AS p FROM h, (SELECT unnest(range({N_FFT // 2 + 1})) AS bin) GROUP BY ALL),
     e AS (SELECT j, CASE WHEN m < 15 THEN m * 200 / 3.0 ELSE 1000 * exp((m - 15) * ln(6.4) / 27) END AS hz FROM (SELECT j, 0.75 + (14.25 + ln({SR} / 2000.0) * 27 / ln(6.4)) * j / {N_MELS + 1} AS m FROM (SELECT unnest(range({N_MELS + 2})) AS j))),
     b AS (SELECT a.j AS mel, bin, greatest(0, least((bin * {SR / N_FFT} - a.hz) / (c.hz - a.hz), (z.hz - bin * {SR / N_FFT}) / (z.hz - c.hz))) * 2 / (z.hz - a.hz) AS w
           FROM e a JOIN e c ON c.j = a.j + 1 JOIN e z ON z.j = a.j + 2, (SELECT unnest(range({N_FFT // 2 + 1})) AS bin)),
     m AS (SELECT vec_id, frame, mel, sum(p * w) AS m FROM d JOIN b USING (bin) GROUP BY ALL)"""
)
MELS = SPECTRA + ", g AS (SELECT vec_id, frame, mel, greatest(db, max(db) OVER (PARTITION BY vec_id) - 80) AS db FROM (SELECT *, 10 * log10(greatest(m + {least}, 1e-10)) AS db FROM m))"
CEPSTRA = MELS.format(least=0) + f", c AS (SELECT vec_id, frame, coef, sum(db * cos(pi() / {N_MELS} * (mel + 0.5) * coef) * sqrt(2.0 / {N_MELS}) / CASE coef WHEN 0 THEN sqrt(2) ELSE 1 END) AS value FROM g, (SELECT unnest(range({N_MFCC})) AS coef) GROUP BY ALL)"


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.frames(recordings(spark, sf_dir), "vec_id", N_FFT, HOP, group=4).withColumn("power", X.power("x"))


def mel_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.log_mel(spectra(spark, sf_dir), "vec_id", SR, N_FFT, N_MELS)


def cepstra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.mfcc_frames(recordings(spark, sf_dir), "vec_id", SR, N_FFT, HOP, N_MELS, N_MFCC)


@query(MELS.format(least=0) + f" SELECT vec_id, frame, mel, round(CAST(frame * {HOP / SR} AS DOUBLE), 6) AS t, round(db, 6) AS db FROM g")
def logmel_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mel_frames(spark, sf_dir).select("vec_id", "frame", F.col("mel").cast("long").alias("mel"), r6("t", "t"), r6("db", "db"))


@query(CEPSTRA + f" SELECT vec_id, frame, coef, round(CAST(frame * {HOP / SR} AS DOUBLE), 6) AS t, round(value, 6) AS value FROM c")
def mfcc_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cepstra(spark, sf_dir).select("vec_id", "frame", F.col("coef").cast("long").alias("coef"), r6("t", "t"), r6("value", "value"))


@query(CEPSTRA + " SELECT vec_id, coef, round(avg(value), 6) AS mean_v, round(stddev_pop(value), 6) AS std_v FROM c GROUP BY vec_id, coef")
def mfcc_clip_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.over_time(cepstra(spark, sf_dir), "vec_id").select("vec_id", F.col("coef").cast("long").alias("coef"), r6("mean", "mean_v"), r6("std", "std_v"))


AMBIENT = MELS.format(least=1e-12) + """,
     v AS (SELECT vec_id, frame, sqrt(avg(v * v)) AS level FROM x GROUP BY ALL),
     f AS (SELECT vec_id, frame, exp(avg(ln(greatest(p, 1e-10)))) / avg(greatest(p, 1e-10)) AS flatness FROM d GROUP BY ALL),
     q AS (SELECT vec_id, frame FROM (SELECT *, quantile_cont(level, 0.3) OVER (PARTITION BY vec_id) AS quiet FROM v) WHERE level <= quiet),
     r AS (SELECT vec_id, mel, quantile_cont(db, 0.25) AS a, quantile_cont(db, 0.5) AS b, quantile_cont(db, 0.75) AS c FROM g JOIN q USING (vec_id, frame) GROUP BY ALL)
SELECT vec_id, 'median' AS part, mel, round(b, 6) AS value FROM r UNION ALL SELECT vec_id, 'iqr', mel, round(c - a, 6) FROM r
UNION ALL SELECT vec_id, 'flatness_mean', -1, round(avg(flatness), 6) FROM f JOIN q USING (vec_id, frame) GROUP BY vec_id
UNION ALL SELECT vec_id, 'flatness_std', -1, round(stddev_pop(flatness), 6) FROM f JOIN q USING (vec_id, frame) GROUP BY vec_id"""


@query(AMBIENT)
def ambient_clip_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = X.ambient_stats(recordings(spark, sf_dir), "vec_id", SR, N_FFT, HOP, N_MELS)
    return out.select("vec_id", "part", F.col("mel").cast("long").alias("mel"), r6("value", "value"))


@query()
def splice_from_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change points of recordings, from samples over cepstral frames to merged boundaries."""
    features, names = X.wide(cepstra(spark, sf_dir), "vec_id", N_MFCC)
    out = jobs.splice_points(features, "vec_id", "t", names, win_sec=2 * HOP / SR, hop_sec=HOP / SR, penalty=0.5, min_size=2, gap_sec=HOP / SR)
    return out.select("vec_id", "n_windows", F.size("boundaries_sec").cast("long").alias("n_boundaries"))


def _filtered() -> str:
    """The band-pass in SQL, a sample after the other: each section's result is the next one's sample."""
    sections = band_sections(LOW, HIGH, ORDER)
    result, before, state = [], "{v}", []
    for k, (gain, a1, a2) in enumerate(sections):
        scaled = f"({gain!r} * {before})"
        before = f"({scaled} + {{p{2 * k}}})"
        state += [f"{{p{2 * k + 1}}} - {a1!r} * {before}", f"-{scaled} - {a2!r} * {before}"]
        result.append(before)
    names = [f"s{k}" for k in range(len(state))]
    start = {f"p{k}": "0.0" for k in range(len(state))} | {"v": "v"}
    onward = {f"p{k}": f"r.s{k}" for k in range(len(state))} | {"v": "l.v"}
    first = ", ".join(f"CAST({s.format(**start)} AS DOUBLE) AS {n}" for s, n in zip(state, names, strict=True))
    after = ", ".join(f"{s.format(**onward)}" for s in state)
    return LONG.replace("WITH", "WITH RECURSIVE") + f", r AS (SELECT vec_id, i, CAST({before.format(**start)} AS DOUBLE) AS y, {first} FROM l WHERE i = 0 UNION ALL SELECT l.vec_id, l.i, {before.format(**onward)}, {after} FROM r JOIN l ON l.vec_id = r.vec_id AND l.i = r.i + 1) "


def hum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.recursive_filter(recordings(spark, sf_dir, HUM_SR, size=20), "vec_id", cascade(band_sections(LOW, HIGH, ORDER)))


@query(_filtered() + "SELECT vec_id, CAST(i AS BIGINT) AS i, round(y, 6) AS y FROM r")
def hum_bandpass(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hum(spark, sf_dir).select("vec_id", "start", F.posexplode("y").alias("k", "y"))
    return rows.select("vec_id", (F.col("start") + F.col("k")).alias("i"), r6("y", "y"))


@query(_filtered() + ", z AS (SELECT vec_id, i, lag(y < 0) OVER (PARTITION BY vec_id ORDER BY i) <> (y < 0) AS turn FROM r) SELECT vec_id, CAST(count(*) AS BIGINT) AS crossings, CAST(min(i) AS BIGINT) AS first_i, CAST(max(i) AS BIGINT) AS last_i FROM z WHERE turn GROUP BY vec_id")
def hum_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.zero_crossings(hum(spark, sf_dir), "vec_id").groupBy("vec_id").agg(F.count(F.lit(1)).alias("crossings"), F.min("i").alias("first_i"), F.max("i").alias("last_i"))


@query("WITH l AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), p AS (SELECT vec_id, i, round(v / (max(abs(v)) OVER (PARTITION BY vec_id) + 1e-9) * 32767) AS q FROM l) SELECT 'v' || vec_id || '.wav' AS file, 16000 AS sr, CAST(i // 16 * 16 AS BIGINT) AS start, count(*) AS n, CAST(sum(q) AS BIGINT) AS total FROM p GROUP BY vec_id, i // 16")
def wav_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings written as PCM files and read back in blocks."""
    wav.register(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='millrace-')}"
    folder = f"{base.rstrip('/')}/wav-{uuid.uuid4().hex}"
    clips = waves(spark, sf_dir).select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("name"), F.lit(SR).alias("sr"), A.peak_normalize(F.col("y")).alias("y"))
    # A file is some work whatever its length, and the table may come in few parts.
    clips = clips.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "name")
    clips.write.format("wav").mode("append").save(folder)
    back = spark.read.format("wav").option("blockSamples", 16).load(folder)
    total = F.aggregate("y", F.lit(0).cast("long"), lambda acc, v: acc + F.round(v * 32768).cast("long"))
    return back.select(F.element_at(F.split("path", "/"), -1).alias("file"), "sr", "start", F.size("y").cast("long").alias("n"), total.alias("total"))

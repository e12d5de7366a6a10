"""Queries over ordered series: windows, statistics, smoothing and alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import arrays as A
from millrace.operators import series as S
from millrace.operators import windows

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
ORDER = ["ts", "event_id"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c, name: str):
    return F.round(c, 6).alias(name)


def query(oracle: str | None):
    """Registers a function under its name, with its oracle."""

    def add(job):
        QUERIES[job.__name__] = job
        if oracle:
            ORACLES[job.__name__] = oracle
        return job

    return add


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value").withColumn("t", S.seconds("ts"))


def indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.with_index(events(spark, sf_dir), "user_id", ORDER)


def waves(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", *more, A.doubles("embedding").alias("y"))


def total(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.select(*keys, r6(value, value))


E = "epoch_us(ts) / 1000000.0::DOUBLE"
#: Samples of each series with position and length, and the ids of the windows of 20 samples, 5 apart, that hold them.
SERIES = f"WITH s AS (SELECT *, {E} AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, count(*) OVER (PARTITION BY user_id) AS n FROM events) "
WINDOWED = SERIES.rstrip() + """,
     w AS (SELECT s.*, unnest(range(greatest(0, CAST(ceil((idx - 19) / 5.0) AS BIGINT)),
                  least(CAST(floor(idx / 5.0) AS BIGINT), greatest(0, CAST(floor((n - 20) / 5.0) AS BIGINT))) + 1)) AS window_idx FROM s)
"""
#: Waves in long form.
LONG = "WITH l AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) "


@query(WINDOWED + "SELECT user_id, window_idx, count(*) AS n, round(avg(value), 6) AS mean_v, round(stddev_pop(value), 6) AS std_v, max(ts) AS t_end FROM w GROUP BY ALL")
def window_stats_meanstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("n"), r6(F.avg("value"), "mean_v"), r6(F.stddev_pop("value"), "std_v"), F.max("ts").alias("t_end")]
    return windows.window_stats(events(spark, sf_dir).select("user_id", "ts", "event_id", "value"), "user_id", ORDER, "value", 20, 5, aggs)


@query(WINDOWED + "SELECT user_id, window_idx, round(median(value), 6) AS med_v, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr_v FROM w GROUP BY ALL")
def window_stats_robust(spark: SparkSession, sf_dir: str) -> DataFrame:
    aggs = [r6(F.percentile("value", F.lit(0.5)), "med_v"), r6(F.percentile("value", F.lit(0.75)) - F.percentile("value", F.lit(0.25)), "iqr_v")]
    return windows.window_stats(events(spark, sf_dir), "user_id", ORDER, "value", 20, 5, aggs)


@query(LONG + "SELECT vec_id, round(avg(v), 6) AS mean_v, round(stddev_pop(v), 6) AS std_v FROM l GROUP BY ALL")
def clip_stats_meanstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return waves(spark, sf_dir).select("vec_id", r6(A.mean(F.col("y")), "mean_v"), r6(A.std_pop(F.col("y")), "std_v"))


@query(LONG + "SELECT vec_id, round(median(v), 6) AS med_v, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 6) AS iqr_v FROM l GROUP BY ALL")
def clip_stats_robust(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = waves(spark, sf_dir).select("vec_id", F.explode("y").alias("v"))
    return long.groupBy("vec_id").agg(r6(F.percentile("v", F.lit(0.5)), "med_v"), r6(F.percentile("v", F.lit(0.75)) - F.percentile("v", F.lit(0.25)), "iqr_v"))


@query(LONG + "SELECT label, CAST(i AS BIGINT) AS band, round(avg(v), 6) AS mean_v, round(var_pop(v), 6) AS var_v FROM l GROUP BY ALL")
def clip_var_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = waves(spark, sf_dir, "label").select("label", F.posexplode("y").alias("band", "v"))
    return long.groupBy("label", F.col("band").cast("long").alias("band")).agg(r6(F.avg("v"), "mean_v"), r6(F.var_pop("v"), "var_v"))


@query(SERIES + "SELECT user_id, event_id, round((value - avg(value) OVER w) / (stddev_pop(value) OVER w + 1e-9), 6) AS z FROM s WINDOW w AS (PARTITION BY user_id)")
def cmvn_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("user_id", "event_id", r6(S.cmvn("value", "user_id"), "z"))


@query(SERIES + "SELECT user_id, event_id, round((value - avg(value) OVER w) / greatest(stddev_pop(value) OVER w, 1e-9), 6) AS z FROM s WINDOW w AS (PARTITION BY user_id)")
def zscore_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("user_id", "event_id", r6(S.zscore("value", "user_id"), "z"))


@query(SERIES + "SELECT user_id, event_id, round(value - avg(value) OVER (PARTITION BY user_id), 9) AS d FROM s")
def detrend_demean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("user_id", "event_id", F.round(S.demean("value", "user_id"), 9).alias("d"))


@query(SERIES + ", f AS (SELECT user_id, regr_slope(value, idx) AS b, avg(value) AS my, avg(idx) AS mx FROM s GROUP BY user_id) SELECT s.user_id, event_id, round(value - (my + b * (idx - mx)), 6) AS d FROM s JOIN f USING (user_id)")
def detrend_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.detrend(indexed(spark, sf_dir), "user_id", "value").select("user_id", "event_id", r6("detrended", "d"))


@query(LONG + "SELECT vec_id, CAST(i AS BIGINT) AS i, round(v / (max(abs(v)) OVER (PARTITION BY vec_id) + 1e-9), 6) AS v FROM l")
def peak_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return waves(spark, sf_dir).select("vec_id", F.posexplode(A.peak_normalize(F.col("y"))).alias("i", "v")).select("vec_id", F.col("i").cast("long").alias("i"), r6("v", "v"))


def framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return waves(spark, sf_dir).select("vec_id", F.posexplode(A.frames(F.col("y"), 16, 8)).alias("frame", "f")).withColumn("frame", F.col("frame").cast("long"))


FRAMES = LONG + ", f AS (SELECT vec_id, fr AS frame, v, i - 8 * fr AS k FROM l, (SELECT unnest(range(7)) AS fr) WHERE i >= 8 * fr AND i < 8 * fr + 16)"


@query(FRAMES + " SELECT vec_id, frame, round(frame * 8 / 16000.0, 6)::DOUBLE AS t, round(max(v) FILTER (WHERE k = 0), 6) AS first_v, round(max(v) FILTER (WHERE k = 15), 6) AS last_v, round(sum(v), 6) AS sum_v FROM f GROUP BY ALL")
def frame_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.col("f")
    return framed(spark, sf_dir).select("vec_id", "frame", r6(F.col("frame") * 8 / F.lit(16000.0), "t"), r6(F.get(f, 0), "first_v"), r6(F.get(f, 15), "last_v"), r6(A.total(f), "sum_v"))


@query(FRAMES + " SELECT vec_id, frame, round(sqrt(avg(v * v)), 6) AS rms FROM f GROUP BY ALL")
def frame_rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return framed(spark, sf_dir).select("vec_id", "frame", r6(A.rms(F.col("f")), "rms"))


@query(FRAMES + ", r AS (SELECT vec_id, frame, round(sqrt(avg(v * v)), 6) AS rms FROM f GROUP BY ALL) SELECT vec_id, frame, rms FROM (SELECT *, quantile_cont(rms, 0.3) OVER (PARTITION BY vec_id) AS p FROM r) WHERE rms <= p")
def vad_quiet_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = frame_rms(spark, sf_dir)
    return r.withColumn("p", F.percentile("rms", F.lit(0.3)).over(Window.partitionBy("vec_id"))).filter("rms <= p").drop("p")


@query(FRAMES + " SELECT vec_id, frame, round(exp(avg(ln(greatest(v * v, 1e-10)))) / avg(greatest(v * v, 1e-10)), 6) AS flatness FROM f GROUP BY ALL")
def spectral_flatness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return framed(spark, sf_dir).select("vec_id", "frame", r6(A.flatness(F.transform("f", lambda x: x * x)), "flatness"))


DFT = LONG + ", m AS (SELECT vec_id, b AS bin, sqrt(pow(sum(v * cos(2 * pi() * b * i / 16)), 2) + pow(sum(v * sin(2 * pi() * b * i / 16)), 2)) AS mag FROM l, (SELECT unnest(range(9)) AS b) WHERE i < 16 GROUP BY ALL)"


def dft(spark: SparkSession, sf_dir: str) -> DataFrame:
    return waves(spark, sf_dir).select("vec_id", A.dft_magnitudes(F.col("y"), 16).alias("m"))


@query(DFT + " SELECT vec_id, bin, round(mag, 6) AS mag FROM m")
def dft_magnitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dft(spark, sf_dir).select("vec_id", F.posexplode("m").alias("bin", "mag")).select("vec_id", F.col("bin").cast("long").alias("bin"), r6("mag", "mag"))


@query(DFT + " SELECT vec_id, arg_max(bin, round(mag, 6) * 1000 - bin * 1e-9) AS peak_bin FROM m WHERE bin BETWEEN 2 AND 6 GROUP BY vec_id")
def band_peak_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    band = F.transform(F.slice("m", 3, 5), lambda x: F.round(x, 6))
    return dft(spark, sf_dir).select("vec_id", (A.first_argmax(band) + 2).cast("long").alias("peak_bin"))


FRAME_DFT = FRAMES + ", m AS (SELECT vec_id, frame, b AS bin, sqrt(pow(sum(v * cos(2 * pi() * b * k / 16)), 2) + pow(sum(v * sin(2 * pi() * b * k / 16)), 2)) AS mag FROM f, (SELECT unnest(range(9)) AS b) GROUP BY ALL)"


def frame_dft(spark: SparkSession, sf_dir: str) -> DataFrame:
    return framed(spark, sf_dir).select("vec_id", "frame", A.dft_magnitudes(F.col("f"), 16).alias("m"))


@query(FRAME_DFT + " SELECT vec_id, frame, bin, round(mag, 6) AS mag FROM m")
def dft_magnitude_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame_dft(spark, sf_dir).select("vec_id", "frame", F.posexplode("m").alias("bin", "mag")).select("vec_id", "frame", F.col("bin").cast("long").alias("bin"), r6("mag", "mag"))


@query(FRAME_DFT + " SELECT vec_id, frame, arg_max(bin, round(mag, 6) * 1000 - bin * 1e-9) AS peak_bin FROM m WHERE bin BETWEEN 2 AND 6 GROUP BY vec_id, frame")
def band_peak_track_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    band = F.transform(F.slice("m", 3, 5), lambda x: F.round(x, 6))
    return frame_dft(spark, sf_dir).select("vec_id", "frame", (A.first_argmax(band) + 2).cast("long").alias("peak_bin"))


@query(LONG + ", d AS (SELECT vec_id, i, 10 * log10(greatest(v * v, 1e-10)) AS db FROM l) SELECT vec_id, CAST(i AS BIGINT) AS i, round(greatest(db, max(db) OVER (PARTITION BY vec_id) - 80), 6) AS db FROM d")
def power_to_db(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = A.power_to_db(F.transform("y", lambda x: x * x))
    return waves(spark, sf_dir).select("vec_id", F.posexplode(db).alias("i", "db")).select("vec_id", F.col("i").cast("long").alias("i"), r6("db", "db"))


ZERO = LONG + ", c AS (SELECT vec_id, i FROM (SELECT *, lag(v < 0) OVER (PARTITION BY vec_id ORDER BY i) AS p FROM l) WHERE (v < 0) <> p)"


@query(ZERO + " SELECT vec_id, count(*) AS crossings, CAST(min(i) AS BIGINT) AS first_i FROM c GROUP BY vec_id")
def zero_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c")
    return waves(spark, sf_dir).select("vec_id", A.sign_changes(F.col("y")).alias("c")).filter(F.size(c) > 0).select("vec_id", F.size(c).cast("long").alias("crossings"), F.get(c, 0).cast("long").alias("first_i"))


@query(ZERO + " SELECT vec_id, round((i + j) / 2.0 / 16000, 9)::DOUBLE AS t, round(0.5 / greatest((j - i) / 16000.0, 1e-9), 6)::DOUBLE AS hz FROM (SELECT *, lead(i) OVER (PARTITION BY vec_id ORDER BY i) AS j FROM c) WHERE j IS NOT NULL")
def half_period_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = waves(spark, sf_dir).select("vec_id", F.explode(A.sign_changes(F.col("y"))).alias("i"))
    j = F.lead("i").over(Window.partitionBy("vec_id").orderBy("i"))
    return c.withColumn("j", j).filter("j IS NOT NULL").select("vec_id", F.round((F.col("i") + F.col("j")) / F.lit(2.0) / F.lit(16000.0), 9).alias("t"), r6(F.lit(0.5) / F.greatest((F.col("j") - F.col("i")) / F.lit(16000.0), F.lit(1e-9)), "hz"))


@query(SERIES + "SELECT user_id, count(value) AS n, round(avg(value - 50), 6) AS mean_dev, round(stddev_pop(value), 6) AS std_dev, round(min(value), 6) AS min_v, round(max(value), 6) AS max_v, CASE WHEN count(value) > 1 THEN round(regr_slope(value, t - t0) * 60, 6) END AS slope_min FROM (SELECT *, min(t) OVER (PARTITION BY user_id) AS t0 FROM s) GROUP BY user_id")
def series_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.summary(events(spark, sf_dir), "user_id", "value", "t", 50.0)
    return out.select("user_id", "n", *[r6(c, c) for c in out.columns[2:]])


@query(SERIES + ", r AS (SELECT user_id, 1.0 / greatest(CASE WHEN count(*) > 1 THEN (max(t) - min(t)) / (count(*) - 1) ELSE 0.01 END, 1e-6) AS fps FROM s GROUP BY user_id) SELECT user_id, round(fps, 9)::DOUBLE AS fps, greatest(1, CAST(round_even(36000 * fps, 0) AS BIGINT)) AS win FROM r")
def frame_rate_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.frame_rate(events(spark, sf_dir), "user_id", "t").select("user_id", F.round("fps", 9).alias("fps"), S.frames_of(36000.0, F.col("fps")).alias("win"))


@query(SERIES + "SELECT user_id, event_id, round(list_sort(list_concat(a, list_resize([]::DOUBLE[], 5 - len(a), 0.0::DOUBLE)))[3], 6) AS v FROM (SELECT *, list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS a FROM s)")
def median_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.median_smooth(events(spark, sf_dir), "user_id", ORDER, "value", 5).select("user_id", "event_id", r6("smoothed", "v"))


LAGS = "SELECT user_id, event_id, v FROM (SELECT user_id, event_id, idx, n, round({}, 6) AS v FROM s WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE v IS NOT NULL"


@query(SERIES + LAGS.format("(-3 * lag(value, 2) OVER o + 12 * lag(value) OVER o + 17 * value + 12 * lead(value) OVER o - 3 * lead(value, 2) OVER o) / 35"))
def savgol_smooth_interior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("user_id", "event_id", r6(S.linear_filter("value", "user_id", ORDER, S.SAVGOL_5), "v")).filter("v IS NOT NULL")


@query(SERIES + LAGS.format("(" + " + ".join(f"{k} * (lead(value, {k}) OVER o - lag(value, {k}) OVER o)" for k in (1, 2, 3, 4)) + ") / 60"))
def delta_interior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("user_id", "event_id", r6(S.linear_filter("value", "user_id", ORDER, S.DELTA_9), "v")).filter("v IS NOT NULL")


GRID = SERIES + """, c AS (SELECT user_id, t, min(value) AS v FROM s WHERE value IS NOT NULL GROUP BY ALL),
 g AS (SELECT user_id, unnest(range(CAST(ceil(min(t) / 21600) AS BIGINT), CAST(floor(max(t) / 21600) AS BIGINT) + 1)) AS g FROM c GROUP BY user_id),
 q AS (SELECT g.user_id, g.g, c.t AS t0, c.v AS v0 FROM g ASOF JOIN c ON g.user_id = c.user_id AND g.g * 21600.0 >= c.t),
 z AS (SELECT q.*, c.t AS t1, c.v AS v1 FROM q ASOF JOIN c ON q.user_id = c.user_id AND q.g * 21600.0 <= c.t),
 i AS (SELECT user_id, g, v0 + CASE WHEN t1 > t0 THEN (v1 - v0) / (t1 - t0) ELSE 0 END * (g * 21600.0 - t0) AS v FROM z) """


def gridded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.interpolate_grid(events(spark, sf_dir), "user_id", "t", "value", 21600)


@query(GRID + "SELECT user_id, g, round(v, 6)::DOUBLE AS v FROM i")
def grid_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gridded(spark, sf_dir).select("user_id", "g", r6("v", "v"))


FROM_START = SERIES + """, c AS (SELECT user_id, t, min(value) AS v FROM s WHERE value IS NOT NULL GROUP BY ALL),
 e AS (SELECT min(t) AS t0, max(t) AS t1 FROM s),
 g AS (SELECT user_id, g, t0 + g * 43200.5 AS x FROM (SELECT DISTINCT user_id FROM s), e, (SELECT unnest(range(CAST(floor((t1 + 1e-9 - t0) / 43200.5) AS BIGINT) + 1)) AS g FROM e)),
 a AS (SELECT g.*, c.t AS pt, c.v AS pv FROM g ASOF LEFT JOIN c ON g.user_id = c.user_id AND g.x >= c.t),
 b AS (SELECT a.*, c.t AS qt, c.v AS qv FROM a ASOF LEFT JOIN c ON a.user_id = c.user_id AND a.x <= c.t),
 k AS (SELECT user_id, count(*) AS n FROM c GROUP BY user_id)
SELECT user_id, g, CASE WHEN pt IS NOT NULL AND qt IS NOT NULL AND n > 1 THEN round(pv + CASE WHEN qt > pt THEN (qv - pv) / (qt - pt) ELSE 0 END * (x - pt), 6) END::DOUBLE AS v FROM b LEFT JOIN k USING (user_id)"""


@query(FROM_START)
def grid_from_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's values on one grid over all events' times; what no number stands for is null here."""
    df = events(spark, sf_dir)
    ends = df.agg(F.min("t").alias("a"), F.max("t").alias("z")).first()
    out = S.interpolate_from(df, "user_id", "t", "value", ends["a"], ends["z"], 43200.5)
    return out.select("user_id", "g", F.when(~F.isnan("v"), F.round("v", 6)).alias("v"))


PAIRS = GRID + ", p AS (SELECT a.user_id, a.g, a.v AS x, b.v AS y FROM i a JOIN i b ON b.user_id = a.user_id + 1 AND a.g = b.g WHERE a.user_id % 2 = 0) "


def series_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = gridded(spark, sf_dir)
    left = v.filter("user_id % 2 = 0").select("user_id", "g", F.col("v").alias("x"))
    return left.join(v.filter("user_id % 2 = 1").select((F.col("user_id") - 1).alias("user_id"), "g", F.col("v").alias("y")), ["user_id", "g"])


@query(PAIRS + "SELECT user_id, g, round(x, 6)::DOUBLE AS x, round(y, 6)::DOUBLE AS y FROM p")
def series_pair_on_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series_pairs(spark, sf_dir).select("user_id", "g", r6("x", "x"), r6("y", "y"))


XCORR = PAIRS + ", k AS (SELECT a.user_id, CAST(b.g - a.g AS INT) AS lag, count(*) AS n, covar_pop(a.x, b.y) / ((stddev_pop(a.x) + 1e-9) * (stddev_pop(b.y) + 1e-9)) AS r FROM p a JOIN p b ON a.user_id = b.user_id AND abs(b.g - a.g) <= 8 GROUP BY ALL HAVING count(*) >= 2) "


@query(XCORR + "SELECT user_id, lag, n, round(r, 6)::DOUBLE AS r FROM k")
def lagged_xcorr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.lagged_correlation(series_pairs(spark, sf_dir), "user_id", "g", "x", "y", 8).select("user_id", "lag", "n", r6("r", "r"))


@query(XCORR + "SELECT user_id, lag AS best_lag, round(r, 6)::DOUBLE AS rho_max FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(r, 9) DESC, lag) AS o FROM k) WHERE o = 1")
def best_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = S.lagged_correlation(series_pairs(spark, sf_dir), "user_id", "g", "x", "y", 8)
    return S.best_lag(k, "user_id").select("user_id", "best_lag", r6("rho_max", "rho_max"))


@query("SELECT user_id, h, event_id, round(value, 6) AS value FROM (SELECT *, date_trunc('hour', ts) AS h, row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY event_id) AS o FROM events WHERE value IS NOT NULL) WHERE o = 1")
def log_clean_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).filter("value IS NOT NULL").withColumn("h", F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz"))
    return S.first_per_time(e, ["user_id", "h"], "event_id").select("user_id", "h", "event_id", r6("value", "value"))


@query(SERIES + "SELECT event_id, round(t * 0.001 + 7.5, 6)::DOUBLE AS t2 FROM s")
def affine_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", r6(F.col("t") * 0.001 + 7.5, "t2"))


@query(SERIES + ", a AS (SELECT user_id, list(t ORDER BY t) AS ts FROM s GROUP BY user_id), k AS (SELECT user_id, list_reduce(ts, lambda acc, x: CASE WHEN len(acc) = 0 OR x[1] - acc[len(acc)] >= 86400 THEN list_concat(acc, x) ELSE acc END) AS kept FROM (SELECT user_id, list_transform(ts, lambda x: [x]) AS ts FROM a)) SELECT user_id, len(kept)::BIGINT AS n_kept, round(kept[1], 3)::DOUBLE AS first_t, round(kept[len(kept)], 3)::DOUBLE AS last_t FROM k")
def merge_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = S.merge_close(events(spark, sf_dir), "user_id", "t", 86400.0)
    return k.select("user_id", F.size("kept").cast("long").alias("n_kept"), F.round(F.get("kept", 0), 3).alias("first_t"), F.round(F.element_at("kept", -1), 3).alias("last_t"))


@query(SERIES + ", m AS (SELECT user_id, (min(t) + max(t)) / 2 AS mid FROM s GROUP BY user_id) SELECT user_id, idx AS nearest_idx FROM (SELECT s.user_id, idx, row_number() OVER (PARTITION BY s.user_id ORDER BY round(abs(t - mid), 6), idx) AS o FROM s JOIN m USING (user_id)) WHERE o = 1")
def nearest_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = indexed(spark, sf_dir)
    mid = s.groupBy("user_id").agg(((F.min("t") + F.max("t")) / 2).alias("mid"))
    return s.join(mid, "user_id").groupBy("user_id").agg(F.min_by("idx", F.struct(F.round(F.abs(F.col("t") - F.col("mid")), 6), "idx")).alias("nearest_idx"))


@query(LONG + "SELECT i::BIGINT AS dim, round((v - avg(v) OVER d) / (stddev_pop(v) OVER d + 1e-9), 6) AS z, vec_id FROM l WINDOW d AS (PARTITION BY i)")
def standardize_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = waves(spark, sf_dir).select("vec_id", F.posexplode("y").alias("dim", "v"))
    # Statistics by partial aggregates, joined back: a window per dimension would send all clips of it to one task.
    stats = F.broadcast(long.groupBy("dim").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")))  # one row per dimension
    return long.join(stats, "dim").select(F.col("dim").cast("long").alias("dim"), r6((F.col("v") - F.col("m")) / (F.col("s") + 1e-9), "z"), "vec_id")


@query(WINDOWED + ", a AS (SELECT user_id, window_idx, avg(value) AS m FROM w GROUP BY ALL), b AS (SELECT user_id, window_idx, max(value) AS x FROM w GROUP BY ALL) SELECT user_id, window_idx, round(m, 6) AS mean_v, round(x, 6) AS max_v FROM a JOIN b USING (user_id, window_idx)")
def modality_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    a = windows.window_stats(e, "user_id", ORDER, "value", 20, 5, [F.avg("value").alias("m")])
    b = windows.window_stats(e, "user_id", ORDER, "value", 20, 5, [F.max("value").alias("x")])
    return a.join(b, ["user_id", "window_idx"]).select("user_id", "window_idx", r6("m", "mean_v"), r6("x", "max_v"))

"""Framewise features as DataFrame algebra over blocks of samples: no task holds a whole recording.

Blocks are rows (key, sr, n, start, y): ``y`` are the samples of a recording from its sample ``start`` on, ``n`` is its
length; its blocks follow each other without gaps. Frames are dealt out in groups of neighbours, ``_g``: one shuffle
brings a group's samples together, a second sums what partial sums left of the bands of its frames.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import dsp
from millrace.functions.recursion import Recursion

#: Frames of a group: what one row holds is their samples.
GROUP = 256


def blocks_of(clips: DataFrame, key: str, sr: int, y: str = "y", size: int = 1 << 16) -> DataFrame:
    """Blocks of recordings that stand in an array column. Null and empty ones have none."""
    n = F.size(y).cast("long")
    cut = clips.filter(F.size(y) > 0).select(key, F.lit(sr).alias("sr"), n.alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1, F.lit(size).cast("long"))).alias("start"), F.col(y).alias("_y"))
    return cut.select(key, "sr", "n", "start", F.slice("_y", (F.col("start") + 1).cast("int"), size).cast("array<double>").alias("y"))


def frames(blocks: DataFrame, key: str, n_fft: int, hop: int, center: bool = True, group: int = GROUP) -> DataFrame:
    """(key, _g, frame, t, x): overlapping frames of ``n_fft`` samples, ``hop`` apart, and their times in seconds.

    Centred frames reach beyond the ends, where the signal is zero; a recording shorter than a frame has one, filled with zeros.
    A block sends each group of frames the samples it has for it, so a sample is sent once, and twice where groups overlap.
    """
    pad, span = n_fft // 2 if center else 0, group * hop
    end = F.col("start") + F.size("y")
    last = F.greatest(F.lit(0), F.floor((F.col("n") + 2 * pad - n_fft) / hop)).cast("long")
    first_g = F.greatest(F.lit(0), F.floor((F.col("start") + pad - n_fft - (group - 1) * hop) / span) + 1).cast("long")
    last_g = F.least(F.floor(F.col("_last") / group), F.floor((end - 1 + pad) / span)).cast("long")
    dealt = blocks.withColumn("_last", last).withColumn("_a", first_g).withColumn("_z", last_g).filter("_a <= _z").withColumn("_g", F.explode(F.sequence("_a", "_z")))
    low = F.col("_g") * span - pad
    begin = F.greatest(low, F.col("start"))
    size = F.greatest(F.lit(0), F.least(low + (group - 1) * hop + n_fft, end) - begin)
    pieces = dealt.select(key, "_g", "sr", "_last", F.struct(begin.alias("at"), F.slice("y", (begin - F.col("start") + 1).cast("int"), size.cast("int")).alias("y")).alias("_p"))
    whole = pieces.groupBy(key, "_g").agg(F.first("sr").alias("sr"), F.first("_last").alias("_last"), F.sort_array(F.collect_list("_p")).alias("_p"))
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)
    samples = F.concat(zeros((F.col("_p")[0]["at"] - low).cast("int")), F.flatten(F.transform("_p", lambda p: p["y"])), zeros(F.lit((group - 1) * hop + n_fft)))
    numbers = F.sequence(F.col("_g") * group, F.least(F.col("_g") * group + (group - 1), F.col("_last")))
    cut = lambda s: F.transform(numbers, lambda f: F.struct(f.alias("frame"), F.slice(s, ((f - F.col("_g") * group) * hop + 1).cast("int"), n_fft).alias("x")))
    out = whole.select(key, "_g", "sr", F.explode(F.flatten(F.transform(F.array(samples), cut))).alias("_f"))
    return out.select(key, "_g", F.col("_f.frame").alias("frame"), (F.col("_f.frame") * hop / F.col("sr")).alias("t"), F.col("_f.x").alias("x"))


def power(x: Column | str) -> Column:
    """Power of each bin of a frame under a periodic Hann window: the one step that Spark's functions lack, on Arrow batches."""

    def spectrum(frames: pd.Series) -> pd.Series:
        if not len(frames):
            return frames
        y = np.stack(frames.to_numpy())
        hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(y.shape[1]) / y.shape[1])
        return pd.Series(list(np.abs(np.fft.rfft(y * hann, axis=1)) ** 2))

    return F.pandas_udf(spectrum, "array<double>")(x)


def matrix(spark: SparkSession, m: np.ndarray, row: str, column: str, weight: str = "w") -> DataFrame:
    """The entries of a matrix that are not 0 as (row, column, weight); a row of zeros keeps one, so that none is lost in a join."""
    keep = m != 0
    keep[~keep.any(axis=1), 0] = True
    r, c = np.nonzero(keep)
    return spark.createDataFrame(pd.DataFrame({row: r, column: c, weight: m[r, c]}), f"{row} int, {column} int, {weight} double")


def times(long: DataFrame, by: DataFrame, keys: list[str], inner: str, outer: str, value: str, out: str) -> DataFrame:
    """Matrix product of a long table with a matrix: an equi-join on ``inner`` and a sum for each of ``keys`` and ``outer``.

    ``by`` is broadcast: its callers' matrices have at most two entries for each bin of a spectrum, or mels by coefficients.
    """
    return long.join(F.broadcast(by), inner).groupBy(*keys, outer).agg(F.sum(F.col(value) * F.col("w")).alias(out))


def kept(df: DataFrame) -> DataFrame:
    """The table, written once to ``spark.checkpoint.dir`` where that is set, so that its several readers do not each compute it:
    Spark reuses no shuffle behind a Python step."""
    spark = df.sparkSession
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        return df
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(where)
    return df.checkpoint()


def log_mel(
    spectra: DataFrame, key: str, sr: int, n_fft: int, n_mels: int = 40, fmin: float = 50.0, fmax: float | None = None, top: float = 80.0, least: float = 0.0, carry: tuple[str, ...] = ()
) -> DataFrame:
    """(key, _g, frame, t, mel, db) of frames with ``power``: mel bands in decibels, at most ``top`` below the recording's largest.

    ``carry``: columns of the frames that go along. The largest values are partial maxima, joined back; never a window over a recording.
    """
    bank = matrix(spectra.sparkSession, dsp.mel_bank(sr, n_fft, n_mels, fmin, fmax), "mel", "bin")
    keys = [key, "_g", "frame", "t", *carry]
    # posexplode() would have Spark filter by the size of the spectrum, and compute it twice for that.
    bins = spectra.select(*keys, F.posexplode_outer("power").alias("bin", "p"))
    mels = kept(times(bins, bank, keys, "bin", "mel", "p", "_m").withColumn("db", 10 * F.log10(F.greatest(F.col("_m") + least, F.lit(1e-10)))).drop("_m"))
    largest = mels.groupBy(key).agg(F.max("db").alias("_top"))
    return mels.join(largest, key).select(*keys, "mel", F.greatest("db", F.col("_top") - top).alias("db"))


def cepstra(mels: DataFrame, key: str, n_mels: int = 40, n_mfcc: int = 20) -> DataFrame:
    """(key, _g, frame, t, coef, value) of log-mel rows: their cosine transform."""
    basis = matrix(mels.sparkSession, dsp.dct_basis(n_mels, n_mfcc), "mel", "coef")
    return times(mels, basis, [key, "_g", "frame", "t"], "mel", "coef", "db", "value")


def mfcc_frames(blocks: DataFrame, key: str, sr: int, n_fft: int = 2048, hop: int = 512, n_mels: int = 40, n_mfcc: int = 20, fmin: float = 50.0) -> DataFrame:
    """(key, frame, t, coef, value) of all recordings at the rate ``sr``; others have another bank and are left out."""
    spectra = frames(blocks.filter(F.col("sr") == sr), key, n_fft, hop).withColumn("power", power("x")).drop("x")
    return cepstra(log_mel(spectra, key, sr, n_fft, n_mels, fmin), key, n_mels, n_mfcc).drop("_g")


def ambient_spectra(blocks: DataFrame, key: str, sr: int, n_fft: int = 1024, hop: int = 160) -> DataFrame:
    """Frames with ``power``, ``level`` (root mean square) and ``flatness`` (geometric over arithmetic mean of the power)."""
    mean = lambda c, f: F.aggregate(c, F.lit(0.0), lambda acc, v: acc + f(v)) / F.size(c)
    made = frames(blocks.filter(F.col("sr") == sr), key, n_fft, hop).withColumn("power", power("x"))
    floor = lambda v: F.greatest(v, F.lit(1e-10))
    flatness = F.exp(mean(F.col("power"), lambda v: F.ln(floor(v)))) / mean(F.col("power"), floor)
    return made.select(key, "_g", "frame", "t", "power", F.sqrt(mean(F.col("x"), lambda v: v * v)).alias("level"), flatness.alias("flatness"))


def ambient_stats(blocks: DataFrame, key: str, sr: int, n_fft: int = 1024, hop: int = 160, n_mels: int = 40, fmin: float = 50.0, quiet_percent: float = 30.0) -> DataFrame:
    """(key, part, mel, value): median and quartile distance of each mel band, then mean and deviation of the flatness (mel -1), over quiet frames.

    Quiet are frames whose level is not above the percentile of their recording; that always leaves one.
    """
    bands = log_mel(ambient_spectra(blocks, key, sr, n_fft, hop), key, sr, n_fft, n_mels, fmin, least=1e-12, carry=("level", "flatness"))
    level = bands.filter("mel = 0").groupBy(key).agg(F.percentile("level", F.lit(quiet_percent / 100)).alias("_quiet"))
    bands = bands.join(level, key).filter("level <= _quiet")
    quiet = bands.filter("mel = 0")
    q = lambda share: F.percentile("db", F.lit(share))
    by_mel = bands.groupBy(key, "mel").agg(q(0.5).alias("median"), (q(0.75) - q(0.25)).alias("iqr")).unpivot([key, "mel"], ["median", "iqr"], "part", "value")
    flat = quiet.groupBy(key).agg(F.avg("flatness").alias("flatness_mean"), F.stddev_pop("flatness").alias("flatness_std")).withColumn("mel", F.lit(-1)).unpivot([key, "mel"], ["flatness_mean", "flatness_std"], "part", "value")
    return by_mel.unionByName(flat)


def over_time(cepstra: DataFrame, key: str) -> DataFrame:
    """(key, coef, mean, std) of each coefficient over its frames: a recording's vector in long form, by partial aggregates."""
    return cepstra.groupBy(key, "coef").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def wide(long: DataFrame, key: str, n: int, index: str = "coef", value: str = "value") -> tuple[DataFrame, list[str]]:
    """Frames as rows (key, frame, t, f0 to f<n - 1>), as change points want them, and the names of those columns."""
    names = [f"f{k}" for k in range(n)]
    return long.groupBy(key, "frame", "t").agg(*[F.max(F.when(F.col(index) == k, F.col(value))).alias(f) for k, f in enumerate(names)]), names


def recursive_filter(blocks: DataFrame, key: str, recursion: Recursion) -> DataFrame:
    """Blocks with ``y`` filtered by a linear recursion that runs through each recording from silence.

    A recursion is an affine map of its state over a block. Each block's map comes from silence; the maps of a recording are
    composed in order, which needs a block's length and its last state alone; then each block runs from its entry state.
    A task holds a block, or the states of one recording: 12 numbers for each of its blocks.
    """
    kind, size = dict(blocks.dtypes)[key], len(recursion.enter)
    state = f"`{key}` {kind}, start long, len long, state array<double>"

    def summarise(parts):
        for pdf in parts:
            yield pd.DataFrame({key: pdf[key], "start": pdf["start"], "len": [len(y) for y in pdf["y"]], "state": recursion.run_each(list(pdf["y"]))[1]})

    def compose(parts):
        maps = {}
        for pdf in parts:
            entries = []
            for lens, states in zip(pdf["len"], pdf["state"], strict=True):
                entry, at = np.empty((len(lens), size)), np.zeros(size)
                for k, (n, own) in enumerate(zip(lens.tolist(), states.reshape(-1, size), strict=True)):
                    entry[k] = at
                    if n not in maps:
                        maps[n] = recursion.over(n)
                    at = maps[n] @ at + own
                entries.append(entry.ravel())
            yield pdf.assign(state=entries)

    def apply(parts):
        for pdf in parts:
            yield pdf.assign(y=recursion.run_each(list(pdf["y"]), list(pdf["state"]))[0]).drop(columns="state")

    blocks = blocks.select(key, "sr", "n", "start", "y")
    # A row for each recording: a batch of them is composed in one call, where a call for each costs more than its sums.
    held = blocks.select(key, "start", "y").mapInPandas(summarise, state).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("start", "len", "state"))).alias("_s"))
    lists = held.select(key, F.col("_s.start").alias("start"), F.col("_s.len").alias("len"), F.flatten("_s.state").alias("state"))
    composed = lists.mapInPandas(compose, f"`{key}` {kind}, start array<long>, len array<long>, state array<double>")
    entries = composed.select(key, F.posexplode("start").alias("_k", "start"), "state").select(key, "start", F.slice("state", F.col("_k") * size + 1, size).alias("state"))
    return blocks.join(entries, [key, "start"]).select(key, "sr", "n", "start", "y", "state").mapInPandas(apply, f"`{key}` {kind}, sr int, n long, start long, y array<double>")


def zero_crossings(blocks: DataFrame, key: str) -> DataFrame:
    """(key, i): samples whose sign differs from that of the one before, across blocks too. Zero counts as positive."""
    sign = F.transform("y", lambda v: v < 0)
    turns = F.filter(F.sequence(F.lit(1), F.size("_s") - 1), lambda k: F.get("_s", k) != F.get("_s", k - 1))
    signed = kept(blocks.select(key, "start", sign.alias("_s")))
    within = signed.filter(F.size("_s") > 1).select(key, F.explode(F.transform(turns, lambda k: F.col("start") + k)).alias("i"))
    ends = signed.select(key, F.col("start").alias("i"), F.get("_s", F.lit(0)).alias("_first"), (F.col("start") + F.size("_s")).alias("_next"), F.element_at("_s", -1).alias("_last"))
    between = ends.join(ends.select(key, F.col("_next").alias("i"), F.col("_last").alias("_before")), [key, "i"]).filter("_first <> _before").select(key, "i")
    return within.unionByName(between)

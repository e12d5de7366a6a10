"""Readers of manifests, logs, protocols and audio, and writers of results. Spark's own readers and writers do the work."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import dsp
from millrace.functions import text as T
from millrace.sources.wav import mono

#: Column names that mean a path, a label, segments, and a segment's start and end. Fixed values.
PATH_NAMES = ("path", "utt", "utterance", "fname", "file", "audio", "relpath")
LABEL_NAMES = ("label", "class", "y", "target", "spoof_type", "bonafide_spoof")
SEGMENT_NAMES = ("segments", "manip_segments", "spoof_segments", "partial", "spoof_region", "regions", "boundaries")
START_NAMES = ("start", "start_sec", "seg_start", "onset", "t0")
END_NAMES = ("end", "end_sec", "seg_end", "offset", "t1")


def clips_manifest(spark: SparkSession, path: str, label_required: bool = False) -> DataFrame:
    """(path, label) of a CSV file with a header; rows without path, or without a label that is required, go."""
    df = spark.read.csv(path, header=True)
    df = df if "label" in df.columns else df.withColumn("label", F.lit(None).cast("string"))
    df = df.filter(F.trim("path") != "").select("path", "label")
    return df.filter(F.trim("label") != "") if label_required else df


def delimited(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A table of strings; short rows are filled with empty texts."""
    return spark.read.csv(path, header=True, sep=sep, mode="PERMISSIVE").fillna("")


def _named(df: DataFrame, names: tuple[str, ...]) -> list[Column]:
    """The table's columns of these names, in any case, in the order of the names; a null counts as an empty text."""
    by = {c.lower(): c for c in reversed(df.columns)}
    return [F.coalesce(F.col(f"`{by[n]}`").cast("string"), F.lit("")) for n in names if n in by]


def row_segments(df: DataFrame) -> Column:
    """Spans of each row: of the first segment column that holds some, else of start and end columns, else of JSON in a cell."""
    ways = [F.array().cast("array<struct<s:double,e:double>>")]
    for cell in reversed(_named(df, SEGMENT_NAMES)):
        ways.insert(0, T.json_segments(cell))
    starts, ends = _named(df, START_NAMES), _named(df, END_NAMES)
    if starts and ends:
        a, b = starts[0].try_cast("double"), ends[0].try_cast("double")
        ways.insert(0, F.when(a.isNotNull() & b.isNotNull(), F.array(F.struct(F.least(a, b).alias("s"), F.greatest(a, b).alias("e")))))
    for cell in reversed(_named(df, SEGMENT_NAMES)):
        parts = F.filter(F.split(cell, "[;|]"), lambda x: F.trim(x) != "")
        ways.insert(0, T.segments(F.array_join(parts, ";"), parts))
    return T.milliseconds_to_seconds(T.first_segments(*ways))


def protocol(df: DataFrame) -> DataFrame:
    """(path, label, segs) of a table of any columns: path and label by the first synonym that it has; without one, its first column
    for the path, and the words of the whole row for the label."""
    path, labels = _named(df, PATH_NAMES), _named(df, LABEL_NAMES)
    words = F.concat_ws(" ", *[F.col(f"`{c}`").cast("string") for c in df.columns])
    return df.select(
        (path[0] if path else F.coalesce(F.col(f"`{df.columns[0]}`").cast("string"), F.lit(""))).alias("path"),
        T.normalize_label(labels[0] if labels else words).alias("label"),
        row_segments(df).alias("segs"),
    )


def label_lines(spark: SparkSession, path: str) -> DataFrame:
    """(token, label, segs) of free-form text lines; blank lines, comments and lines of one field go."""
    lines = spark.read.text(path).filter(~F.col("value").rlike(r"^\s*(#|$)")).select(T.split_fields(F.trim("value")).alias("f")).filter(F.size("f") >= 2)
    rest = F.slice("f", F.lit(3), F.greatest(F.size("f") - 2, F.lit(0)))
    segs = T.milliseconds_to_seconds(T.segments(F.array_join(rest, ";"), rest))
    return lines.select(F.get("f", 0).alias("token"), T.normalize_label(F.get("f", 1)).alias("label"), segs.alias("segs"))


def json_items(spark: SparkSession, path: str, item: str) -> DataFrame:
    """Items of JSON files: a list, or an object that wraps one as items, data or entries, or a single object; malformed files have none."""
    text = spark.read.text(path, wholetext=True).filter(F.try_parse_json("value").isNotNull())
    wrapped = F.from_json("value", f"items array<{item}>, data array<{item}>, entries array<{item}>")
    single = F.from_json("value", item)
    listed = F.when(F.trim("value").startswith("["), F.from_json("value", f"array<{item}>"))
    rows = F.coalesce(listed, wrapped["items"], wrapped["data"], wrapped["entries"], F.when(~F.trim("value").startswith("["), F.array(single)))
    return text.select(F.explode(rows).alias("item")).filter("item IS NOT NULL").select("item.*")


def frequency_log(spark: SparkSession, path: str, time: str = "time", value: str = "fi", sep: str = ",", header: bool = True, scale: float = 1.0, offset: float = 0.0) -> DataFrame:
    """(t, fi) of a log; rows that are no numbers go, and of rows of one time the first in the file stays."""
    df = spark.read.csv(path, header=header, sep=sep)
    number = lambda name: F.col(f"`{name}`").try_cast("double")
    t, fi = (time, value) if header else ("_c0", "_c1")
    rows = df.select((number(t) * scale + offset).alias("t"), number(fi).alias("fi"), F.monotonically_increasing_id().alias("seq"))
    return rows.dropna().groupBy("t").agg(F.min_by("fi", "seq").alias("fi"))


def audio_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, label, content) of audio files anywhere below root/<label>/, found by extension; files of the root itself go."""
    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString().rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    below = F.split(F.substr(F.col("path"), F.lit(len(base) + 2)), "/")
    return files.filter(T.has_audio_extension(F.col("path")) & (F.size(below) > 1)).select("path", below[0].alias("label"), "content")


def decode_wav(content: bytes, target: int = 16000) -> np.ndarray:
    """Mono samples of a PCM file at the target rate, the largest magnitude about 1."""
    with wave.open(io.BytesIO(content)) as w:
        width, channels, sr = w.getsampwidth(), w.getnchannels(), w.getframerate()
        raw = w.readframes(w.getnframes())
    return dsp.normalize_peak(dsp.resample(mono(raw, width, channels), sr, target))


def load_audio(files: DataFrame, target: int = 16000) -> DataFrame:
    """(path, y, sr, status) of files with content; what cannot be decoded is a row with its reason."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out: list = []
            for content in pdf["content"]:
                try:
                    out.append((decode_wav(content, target).astype(np.float32), "ok"))
                except (wave.Error, EOFError, ValueError) as error:
                    out.append((None, f"err: {error}"))
            yield pd.DataFrame({"path": pdf["path"], "y": [y for y, _ in out], "sr": target, "status": [s for _, s in out]})

    return files.select("path", "content").mapInPandas(run, "path string, y array<float>, sr int, status string")


def head_scores(spark: SparkSession, path: str, ignored: tuple[str, ...] = ("label", "audio_id", "id", "file")) -> tuple[DataFrame, list[str]]:
    """A score table and its feature columns: all numeric ones that are no ids."""
    df = spark.read.csv(path, header=True, inferSchema=True)
    return df, [c for c, kind in df.dtypes if c not in ignored and kind in ("double", "int", "bigint", "float")]


def key_values(text: Column) -> Column:
    """Scores of texts like a=0.1,b=0.2."""
    return F.transform_values(F.str_to_map(text, F.lit(","), F.lit("=")), lambda k, v: v.cast("double"))


def write_csv(df: DataFrame, path: str) -> None:
    """Each row once, with a header."""
    df.dropDuplicates().write.mode("overwrite").csv(path, header=True)


def write_features(df: DataFrame, path: str) -> None:
    """Appends to the feature store; a scan of one setting reads its folder alone."""
    df.write.mode("append").partitionBy("cfg_hash").parquet(path)


def write_predictions(df: DataFrame, classes: list[str], path: str) -> None:
    """path, true_label, pred_label and a column prob_<class> for each class, from an array of probabilities."""
    df.select("path", "true_label", "pred_label", *[F.get("probability", i).alias(f"prob_{c}") for i, c in enumerate(classes)]).write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)

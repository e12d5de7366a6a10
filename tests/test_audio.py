"""From samples to features in blocks: against plain NumPy over whole recordings, and the standard library's reader of audio."""

import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import dsp
from millrace.functions.recursion import Recursion, band_sections, cascade
from millrace.operators import frames as X
from millrace.sources.wav import register


def plain_recursion(r, x):
    """One sample after the other."""
    state, out = np.zeros(len(r.enter)), []
    for v in x:
        out.append(r.leave @ state + r.direct * v)
        state = r.move @ state + r.enter * v
    return np.array(out)


def recordings(spark, lengths, sr=8000, size=1000):
    rng = np.random.default_rng(4)
    clips = {k: rng.normal(size=n) for k, n in enumerate(lengths)}
    df = spark.createDataFrame([(k, y.tolist()) for k, y in clips.items()], "clip long, y array<double>")
    return clips, X.blocks_of(df, "clip", sr, size=size)


@pytest.mark.parametrize(("n_fft", "hop", "center", "group", "size"), [(64, 16, True, 4, 1000), (64, 64, False, 3, 7), (32, 50, True, 256, 333), (64, 16, False, 1, 10000)])
def test_frames_are_those_of_whole_recordings(spark, n_fft, hop, center, group, size):
    clips, blocks = recordings(spark, [2500, 1, 63, 64, 65, 1000, 0, 1001], size=size)
    got = X.frames(blocks, "clip", n_fft, hop, center, group).collect()
    for k, y in clips.items():
        rows = sorted((r["frame"], r["t"], r["x"]) for r in got if r["clip"] == k)
        want = dsp.windows_of(y, n_fft, hop, center) if len(y) else np.zeros((0, n_fft))
        assert [f for f, _, _ in rows] == list(range(len(want))) and np.allclose([t for _, t, _ in rows], np.arange(len(want)) * hop / 8000)
        assert not len(want) or np.array_equal(np.array([x for _, _, x in rows]), want)


def test_cepstra_are_the_matrix_products(spark):
    clips, blocks = recordings(spark, [9000, 3000], size=700)
    got = X.mfcc_frames(blocks, "clip", 8000, 256, 64, 20, 13).collect()
    for k, y in clips.items():
        want = dsp.mfcc(y, 8000, 13, 20, 256, 64)
        mine = np.full(want.shape, np.nan)
        for r in got:
            if r["clip"] == k:
                mine[r["frame"], r["coef"]] = r["value"]
        assert np.allclose(mine, want)
    other = X.mfcc_frames(blocks, "clip", 16000, 256, 64, 20, 13)
    assert other.count() == 0


def test_ambient_statistics_are_those_of_whole_recordings(spark):
    clips, blocks = recordings(spark, [9000, 5000], size=900)
    got = {(r["clip"], r["part"], r["mel"]): r["value"] for r in X.ambient_stats(blocks, "clip", 8000, 256, 64, 12).collect()}
    for k, y in clips.items():
        want = dsp.ambient_vector(y, 8000, 12, 256, 64)
        mine = [got[k, p, m] for p in ("median", "iqr") for m in range(12)] + [got[k, f"flatness_{p}", -1] for p in ("mean", "std")]
        assert np.allclose(mine, want)


def test_spectra_are_made_once(spark):
    """The recordings' largest values come from the very bands that are cut by them; banks are broadcast, samples move once."""
    _, blocks = recordings(spark, [9000])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        spectra = X.frames(blocks, "clip", 256, 64).withColumn("power", X.power("x")).drop("x")
        plan = X.cepstra(X.log_mel(spectra, "clip", 8000, 256, 20), "clip", 20, 13)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "ArrowEvalPython" not in plan and "Scan ExistingRDD" in plan, plan  # the bands were written, and are read twice
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 5000, 70001])
def test_recursions_in_stretches_are_sequential_ones(n):
    rng = np.random.default_rng(n)
    x, r = rng.normal(size=n), cascade(band_sections(0.1, 0.2, 3))
    got, state = r.run(x)
    assert np.allclose(got, plain_recursion(r, x), rtol=1e-9, atol=1e-12)
    k = n // 3
    first, between = r.run(x[:k])
    second, last = r.run(x[k:], between)
    assert np.allclose(np.concatenate([first, second]), got, atol=1e-12) and np.allclose(last, state, atol=1e-12)


def test_a_million_samples_are_filtered_block_by_block(spark):
    """Neither a task nor the driver holds the recording: 16 blocks and two others, dealt by Spark."""
    rng = np.random.default_rng(8)
    n, sr = 1_000_000, 1000
    long = rng.normal(size=n) + np.sin(2 * np.pi * 60.2 * np.arange(n) / sr)
    r = cascade(band_sections(58.5 / 500, 61.5 / 500, 6))
    rows = [("long", sr, n, a, long[a : a + 65536].tolist()) for a in range(0, n, 65536)] + [("short", sr, 300, 0, long[:200].tolist()), ("short", sr, 300, 200, long[200:300].tolist())]
    blocks = spark.createDataFrame(rows, "clip string, sr int, n long, start long, y array<double>").repartition(6)
    out = X.recursive_filter(blocks, "clip", r).cache()
    got = {(b["clip"], b["start"]): b["y"] for b in out.collect()}
    whole = np.concatenate([got["long", a] for a in range(0, n, 65536)])
    want = plain_recursion(r, long[:140_000])
    assert len(whole) == n and np.allclose(whole[:140_000], want, atol=1e-9)
    assert np.allclose(whole, r.run(long)[0], atol=1e-9)
    assert np.allclose(got["short", 0] + got["short", 200], want[:300], atol=1e-12)
    turns = sorted(x["i"] for x in X.zero_crossings(out, "clip").filter("clip = 'long'").collect())
    assert turns == (np.flatnonzero(np.diff(whole < 0)) + 1).tolist()
    assert abs(0.5 * sr / np.diff(turns[len(turns) // 2 :]).mean() - 60.2) < 0.05


def test_recursions_of_any_kind():
    """A running sum with a leak, as a recursion of one number."""
    r = Recursion(np.array([[0.9]]), np.array([1.0]), np.array([0.9]), 1.0)
    assert np.allclose(r.run(np.ones(1000))[0], 10 * (1 - 0.9 ** np.arange(1, 1001)))


def save(path, y, width=2, channels=1, sr=8000):
    top = 1 << (8 * width - 1)
    q = np.clip(np.rint(y * (top - 1)), -top, top - 1).astype(np.int64)
    raw = (q + 128).astype(np.uint8).tobytes() if width == 1 else b"".join(int(v).to_bytes(3, "little", signed=True) for v in q) if width == 3 else q.astype(f"<i{width}").tobytes()
    with wave.open(str(path), "wb") as w:
        w.setparams((channels, width, sr, 0, "NONE", ""))
        w.writeframes(raw)
    return q / top if width > 1 else q / 128


@pytest.fixture(scope="module")
def wav(spark):
    register(spark)
    return lambda folder, **options: spark.read.format("wav").options(**options).load(str(folder))


def samples(rows, path):
    held = sorted((r["start"], r["y"]) for r in rows if r["path"].endswith(path))
    assert [s for s, _ in held] == np.cumsum([0] + [len(y) for _, y in held])[:-1].tolist()
    return np.concatenate([y for _, y in held])


def test_long_files_are_read_in_ranges(spark, wav, tmp_path):
    rng = np.random.default_rng(2)
    want = {}
    for name, n, width, channels in (("long", 1_500_000, 2, 1), ("stereo", 40_000, 2, 2), ("bytes", 5_000, 1, 1), ("three", 9_000, 3, 1), ("four", 7_001, 4, 1)):
        (tmp_path / "a").mkdir(exist_ok=True)
        want[name] = save(tmp_path / "a" / f"{name}.wav", rng.uniform(-1, 1, n * channels), width, channels).reshape(-1, channels).mean(axis=1)
    df = wav(tmp_path, partitionBytes=100_001, blockSamples=4096)
    assert df.rdd.getNumPartitions() > 30
    rows = df.collect()
    for name, y in want.items():
        got = samples(rows, f"/{name}.wav")
        assert np.allclose(got, y, atol=1e-6) and {r["n"] for r in rows if r["path"].endswith(f"/{name}.wav")} == {len(y)}
    with wave.open(str(tmp_path / "a" / "long.wav")) as w:
        raw = np.frombuffer(w.readframes(w.getnframes()), "<i2")
    assert np.array_equal(np.rint(samples(rows, "/long.wav") * 32768).astype(int), raw)


def test_broken_files_are_rows_with_a_reason(wav, tmp_path):
    good = tmp_path / "good.wav"
    y = save(good, np.linspace(-1, 1, 3000))
    data = good.read_bytes()
    (tmp_path / "cut.wav").write_bytes(data[:2045])  # an odd byte is left over
    (tmp_path / "empty.wav").write_bytes(b"")
    (tmp_path / "text.WAV").write_bytes(b"no audio at all, but long enough for a header")
    (tmp_path / "silent.wav").write_bytes(data[:44].replace(struct.pack("<I", 6000), struct.pack("<I", 0)))
    (tmp_path / "float.wav").write_bytes(data[:20] + struct.pack("<H", 3) + data[22:])
    (tmp_path / "notes.txt").write_bytes(data)
    (tmp_path / "extra.wav").write_bytes(data[:12] + b"LIST" + struct.pack("<I", 5) + b"abcde\0" + data[12:])  # a chunk of odd length first
    rows = wav(tmp_path, partitionBytes=1500).collect()
    state = {}
    for r in rows:
        state.setdefault(r["path"].rsplit("/", 1)[1], set()).add(r["status"].split(" (")[0])
    assert state == {"good.wav": {"ok"}, "cut.wav": {"ok"}, "extra.wav": {"ok"}, "empty.wav": {"err: no RIFF/WAVE header"}, "text.WAV": {"err: no RIFF/WAVE header"}, "silent.wav": {"err: no samples"}, "float.wav": {"err: not PCM of 8 to 32 bits"}}
    assert sum(not r["status"].startswith("ok") for r in rows) == 4
    assert np.allclose(samples(rows, "/good.wav"), y) and np.allclose(samples(rows, "/extra.wav"), y) and np.allclose(samples(rows, "/cut.wav"), y[:1000], atol=1e-6)
    assert wav(tmp_path / "good.wav").count() == 1


def test_conditions_on_the_path_choose_files(spark, wav, tmp_path):
    for k in range(6):
        save(tmp_path / f"f{k}.wav", np.zeros(1000))
    df = wav(tmp_path, partitionBytes=2044)
    root = df.first()["path"].rsplit("/", 1)[0]
    assert df.rdd.getNumPartitions() == 6
    for wanted, n in ((df.filter(F.col("path") == f"{root}/f3.wav"), 1), (df.filter(F.col("path").isin(f"{root}/f1.wav", f"{root}/f2.wav", "x")), 2), (df.filter(F.col("path").endswith("5.wav") & (F.col("sr") > 0)), 1), (df.filter(F.col("path").startswith(f"{root}/none")), 0)):
        assert wanted.count() == n and wanted.rdd.getNumPartitions() == max(1, n)


def test_recordings_written_are_read_back(spark, wav, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(f"r{k}", 8000 + k, rng.uniform(-1.2, 1.2, 10 + k).tolist()) for k in range(5)]
    df = spark.createDataFrame(rows, "name string, sr int, y array<double>")
    for _ in range(2):  # a second run puts the same files in their places
        df.write.format("wav").mode("append").save(str(tmp_path / "out"))
    back = {r["path"].rsplit("/", 1)[1]: r for r in wav(tmp_path / "out").collect()}
    assert len(back) == 5
    for name, sr, y in rows:
        r = back[f"{name}.wav"]
        assert r["sr"] == sr and np.allclose(np.rint(np.array(r["y"]) * 32768), np.rint(np.clip(y, -1, 1) * 32767))


def test_features_come_from_files(spark, wav, tmp_path):
    """Files to cepstra: the same as from the whole recording in memory."""
    y = save(tmp_path / "one.wav", np.random.default_rng(1).uniform(-1, 1, 30_000))
    blocks = wav(tmp_path, partitionBytes=9_000, blockSamples=1000).filter("status = 'ok'").withColumn("y", F.col("y").cast("array<double>"))
    got = X.mfcc_frames(blocks, "path", 8000, 256, 64, 20, 13).orderBy("frame", "coef").collect()
    assert np.allclose(np.array([r["value"] for r in got]).reshape(-1, 13), dsp.mfcc(y, 8000, 13, 20, 256, 64), atol=1e-4)

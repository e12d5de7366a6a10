"""What a job sends, opens or runs again does not grow faster than its tables."""

import numpy as np

from millrace.functions.recursion import band_sections, cascade
from millrace.operators import jobs, learning
from millrace.sources.wav import WavReader


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_short_blocks_run_together_as_alone():
    rng, recursion = np.random.default_rng(2), cascade(band_sections(0.2, 0.4, 2))
    blocks = [rng.normal(size=n) for n in (20, 4, 20, 700, 4, 1)]
    states = [rng.normal(size=len(recursion.enter)) for _ in blocks]
    for y, s, (want, after) in zip(*recursion.run_each(blocks, states), [recursion.run(b, s) for b, s in zip(blocks, states, strict=True)], strict=True):
        assert np.allclose(y, want) and np.allclose(s, after)


def test_short_files_are_dealt_over_tasks(tmp_path):
    for k in range(1500):
        (tmp_path / f"{k}.wav").write_bytes(b"x" * 172)
    parts = WavReader({"path": str(tmp_path)}).partitions()
    assert sum(len(p.ranges) for p in parts) == 1500 and max(len(p.ranges) for p in parts) <= 512


def test_fusion_takes_few_jobs(spark):
    rng = np.random.default_rng(4)
    rows = [(float(a), float(b), float(a + b + rng.normal() > 0)) for a, b in rng.normal(size=(300, 2))]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    spark.sparkContext.setJobGroup("fusion", "fusion")
    learning.fuse(df, ["a", "b"], "y", "isotonic").collect()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("fusion")) < 80


def test_change_points_are_searched_once(spark):
    rows = [(k, float(i), float(i > 30) + 0.01 * (i % 3)) for k in range(2) for i in range(60)]
    out = jobs.splice_points(spark.createDataFrame(rows, "k int, t double, v double"), "k", "t", ["v"], win_sec=4.0, hop_sec=2.0, penalty=0.5, min_size=2, gap_sec=1.0)
    assert "FlatMapGroups" not in plan(out)
    assert all(r["n_windows"] == 29 and len(r["boundaries_sec"]) >= 1 for r in out.collect())

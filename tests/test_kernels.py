"""NumPy kernels against definitions and known answers; no Spark."""

import numpy as np
import pytest

from millrace.functions import dsp
from millrace.operators import changepoint
from millrace.operators.extract import AmbientConfig, HumConfig, MfccConfig, config_hash


def tone(hz, sr=16000, sec=4.0):
    return np.sin(2 * np.pi * hz * np.arange(int(sr * sec)) / sr)


def test_spectrogram_is_the_definition():
    y = np.random.default_rng(1).normal(size=64)
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(16) / 16)
    padded = np.pad(y, 8)
    frame = padded[8:24] * hann
    naive = [abs(sum(frame[n] * np.exp(-2j * np.pi * k * n / 16) for n in range(16))) ** 2 for k in range(9)]
    assert np.allclose(dsp.spectrogram(y, 16, 8)[1], naive)


def test_dct_basis_is_orthonormal():
    b = dsp.dct_basis(8, 8)
    assert np.allclose(b.T @ b, np.eye(8))


def test_delta_of_a_line_is_its_slope():
    m = np.arange(20.0)[:, None] * 3
    assert np.allclose(dsp.delta(m), 3)
    with pytest.raises(ValueError):
        dsp.delta(m[:8])


def test_hum_tracking():
    t, f = dsp.hum_zero_crossings(tone(60), 16000)
    assert abs(f[len(f) // 2 :].mean() - 60) < 0.1 and (np.diff(t) > 0).all()
    _, g = dsp.hum_peaks(tone(60), 16000)
    assert set(g) == {58.59375}
    _, h = dsp.hum_peaks(tone(60), 16000, between=True)
    assert abs(np.median(h) - 60) < 1
    assert np.isnan(dsp.hum_vector(np.zeros(0), np.zeros(0))).all()


def test_band_pass_keeps_the_band_alone():
    inside, outside = dsp.band_pass(tone(60), 0.005, 0.01), dsp.band_pass(tone(300), 0.005, 0.01)
    assert 0.8 < np.abs(inside[32000:]).max() < 1.1 and np.abs(outside[32000:]).max() < 1e-3


def test_resample_keeps_a_tone():
    y = dsp.resample(tone(440, 44100, 0.5), 44100, 16000)
    assert np.allclose(y[200:-200], tone(440, 16000, 0.5)[200 : len(y) - 200], atol=5e-3)


def test_vector_sizes_and_hash():
    y = tone(200, sec=1.0)
    for config in (MfccConfig(), MfccConfig(second=True), AmbientConfig(), HumConfig()):
        assert len(config.extract(y, 16000)) == config.size
    assert config_hash([MfccConfig()]) != config_hash([MfccConfig(n_mels=41)])
    with pytest.raises(ValueError):
        HumConfig(strategy="other")


def test_change_points_find_the_step():
    x = changepoint.standardize(np.concatenate([np.zeros((15, 1)), np.ones((15, 1))]) + np.random.default_rng(2).normal(scale=0.05, size=(30, 1)))
    assert changepoint.with_breaks(x, 1, 3) == [15, 30]
    assert changepoint.penalised(x, 1.0, 3) == [15, 30]
    assert changepoint.penalised(x[:4], 1.0, 3) == [4]
    sums = changepoint.kernel_sums(x)
    best = min((changepoint.cost(sums, 0, m) + changepoint.cost(sums, m, 30), m) for m in range(3, 28))
    assert best[1] == 15


def test_smoothing_by_seconds():
    x = np.linspace(0, 3, 40) ** 3
    assert np.allclose(dsp.smooth(x, 20.0, 1.0), x)  # a cubic is its own fit, at the ends too
    noisy = np.where(np.arange(40) == 20, 99.0, 1.0)
    assert dsp.smooth(noisy, 20.0, 0.25, "median")[20] == 1.0 and dsp.smooth(noisy, 20.0, 0.25, "median")[0] == 1.0
    assert np.array_equal(dsp.smooth(noisy, 20.0, 0.0), noisy) and np.array_equal(dsp.smooth(noisy[:3], 20.0, 1.0), noisy[:3]) and not len(dsp.smooth(noisy[:0], 20.0, 1.0))

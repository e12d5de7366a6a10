"""Signal kernels in NumPy, for use inside Arrow tasks: spectra, mel and cepstral features, hum tracking, resampling."""

from __future__ import annotations

import math

import numpy as np

from millrace.functions.recursion import band_sections, cascade


def windows_of(y: np.ndarray, size: int, hop: int, center: bool = True) -> np.ndarray:
    """Overlapping frames; centred frames reach beyond the ends, where the signal is zero."""
    if center:
        y = np.pad(y, size // 2)
    if len(y) < size:
        y = np.pad(y, (0, size - len(y)))
    return np.lib.stride_tricks.sliding_window_view(y, size)[::hop]


def spectrogram(y: np.ndarray, n_fft: int, hop: int) -> np.ndarray:
    """Power, frames by bins, under a periodic Hann window."""
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n_fft) / n_fft)
    return np.abs(np.fft.rfft(windows_of(y, n_fft, hop) * hann, axis=1)) ** 2


def mel_of(hz: np.ndarray) -> np.ndarray:
    """Linear below 1000 Hz, logarithmic above; the published auditory-toolbox form."""
    hz = np.asarray(hz, float)
    return np.where(hz < 1000, hz / (200 / 3), 15 + np.log(np.maximum(hz, 1000) / 1000) / (np.log(6.4) / 27))


def hz_of(mel: np.ndarray) -> np.ndarray:
    mel = np.asarray(mel, float)
    return np.where(mel < 15, mel * (200 / 3), 1000 * np.exp((mel - 15) * (np.log(6.4) / 27)))


def mel_bank(sr: int, n_fft: int, n_mels: int, fmin: float, fmax: float | None = None) -> np.ndarray:
    """Triangles of unit area, mels by bins."""
    bins = np.arange(n_fft // 2 + 1) * sr / n_fft
    edges = hz_of(np.linspace(mel_of(fmin), mel_of(fmax or sr / 2), n_mels + 2))
    rise = (bins - edges[:-2, None]) / np.diff(edges)[:-1, None]
    fall = (edges[2:, None] - bins) / np.diff(edges)[1:, None]
    return np.maximum(0, np.minimum(rise, fall)) * (2 / (edges[2:] - edges[:-2]))[:, None]


def decibels(power: np.ndarray, top: float = 80.0) -> np.ndarray:
    db = 10 * np.log10(np.maximum(power, 1e-10))
    return np.maximum(db, db.max() - top) if db.size else db


def dct_basis(n: int, keep: int) -> np.ndarray:
    """Orthonormal type-2 cosine basis, n by keep."""
    basis = np.cos(np.pi / n * (np.arange(n)[:, None] + 0.5) * np.arange(keep)) * math.sqrt(2 / n)
    basis[:, 0] /= math.sqrt(2)
    return basis


def mfcc(y: np.ndarray, sr: int, n_mfcc: int = 20, n_mels: int = 40, n_fft: int = 2048, hop: int = 512, fmin: float = 50.0) -> np.ndarray:
    """Frames by coefficients."""
    return decibels(spectrogram(y, n_fft, hop) @ mel_bank(sr, n_fft, n_mels, fmin).T) @ dct_basis(n_mels, n_mfcc)


def delta(m: np.ndarray, width: int = 9) -> np.ndarray:
    """Slope of the least-squares line over ``width`` frames around each; at the ends that of the line of the end frames."""
    h = width // 2
    if len(m) < width:
        raise ValueError(f"{len(m)} frames are fewer than the {width} that a derivative needs")
    k = np.arange(-h, h + 1)
    inner = np.tensordot(np.lib.stride_tricks.sliding_window_view(m, width, axis=0), k / (k @ k), axes=(-1, 0))
    return np.concatenate([np.repeat(inner[:1], h, axis=0), inner, np.repeat(inner[-1:], h, axis=0)])


def over_time(m: np.ndarray, robust: bool = False) -> np.ndarray:
    """Mean and population deviation of each column, or median and quartile distance."""
    if robust:
        low, middle, high = np.percentile(m, [25, 50, 75], axis=0)
        return np.concatenate([middle, high - low])
    return np.concatenate([m.mean(axis=0), m.std(axis=0)])


def mfcc_vector(y: np.ndarray, sr: int, n_mfcc: int = 20, second: bool = False, **more) -> np.ndarray:
    m = mfcc(y, sr, n_mfcc, **more)
    parts = [m, delta(m)]
    if second:
        parts.append(delta(parts[1]))
    return np.concatenate([over_time(p) for p in parts])


def ambient_vector(y: np.ndarray, sr: int, n_mels: int = 40, n_fft: int = 1024, hop: int = 160, fmin: float = 50.0, robust: bool = True, quiet_percent: float = 30.0) -> np.ndarray:
    """Statistics of the log-mel spectrum and flatness of quiet frames: those whose level is not above the percentile."""
    power = spectrogram(y, n_fft, hop)
    db = decibels(power @ mel_bank(sr, n_fft, n_mels, fmin).T + 1e-12)
    floor = np.maximum(power, 1e-10)
    flatness = np.exp(np.log(floor).mean(axis=1)) / floor.mean(axis=1)
    level = np.sqrt((windows_of(y, n_fft, hop) ** 2).mean(axis=1))
    n = min(len(db), len(level))
    keep = level[:n] <= np.percentile(level[:n], quiet_percent)
    keep = keep if keep.any() else np.ones(n, bool)
    return np.concatenate([over_time(db[:n][keep], robust), [flatness[:n][keep].mean(), flatness[:n][keep].std()]])


def band_pass(y: np.ndarray, low: float, high: float, order: int = 6) -> np.ndarray:
    """Butterworth band-pass, causal; edges as shares of half the sampling rate."""
    return cascade(band_sections(low, high, order)).run(y)[0]


def hum_zero_crossings(y: np.ndarray, sr: int, nominal: float = 60.0, bandwidth: float = 1.5) -> tuple[np.ndarray, np.ndarray]:
    """Times and frequencies from the half periods of the band around the nominal frequency."""
    low, high = max(0.0, (nominal - bandwidth) / (sr / 2)), min(0.999, (nominal + bandwidth) / (sr / 2))
    if low >= high or not len(y):
        return np.zeros(0), np.zeros(0)
    at = np.flatnonzero(np.diff(np.signbit(band_pass(y, low, high)))) + 1
    if len(at) < 2:
        return np.zeros(0), np.zeros(0)
    t = at / sr
    return (t[1:] + t[:-1]) / 2, 0.5 / np.maximum(np.diff(t), 1e-9)


def hum_peaks(y: np.ndarray, sr: int, nominal: float = 60.0, bandwidth: float = 1.5, n_fft: int = 4096, hop: int = 2048, between: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Times and the strongest bin of the band in each frame; ``between`` places it by a parabola over its neighbours."""
    bins = np.arange(n_fft // 2 + 1) * sr / n_fft
    band = np.flatnonzero((bins >= nominal - bandwidth) & (bins <= nominal + bandwidth))
    if not len(band) or not len(y):
        return np.zeros(0), np.zeros(0)
    magnitude = np.sqrt(spectrogram(y, n_fft, hop))
    k = band[magnitude[:, band].argmax(axis=1)]
    f = bins[k]
    if between:
        rows = np.arange(len(k))
        a, b, c = (np.log(magnitude[rows, np.clip(k + d, 0, len(bins) - 1)] + 1e-12) for d in (-1, 0, 1))
        f = f + np.clip(0.5 * (a - c) / np.minimum(a - 2 * b + c, -1e-12), -0.5, 0.5) * sr / n_fft
    return np.arange(len(f)) * hop / sr, f


def smooth(x: np.ndarray, rate: float, seconds: float, method: str = "savgol") -> np.ndarray:
    """A series smoothed over ``seconds`` at ``rate`` values a second: the window is an odd number of values, 3 at least.

    ``median``: the median around each value, zeros beyond the ends. ``savgol``: a polynomial fitted to each window, of degree
    a fifth of its length and between 1 and 3; the first and last half window come from one fit each. A series shorter than
    the window, without values, or no seconds: the series as it is (median: still smoothed).
    """
    if not len(x) or seconds <= 0:
        return x
    size = max(3, round(seconds * rate))
    size += size % 2 == 0
    half = size // 2
    if method == "median":
        return np.median(np.lib.stride_tricks.sliding_window_view(np.pad(x, half), size), axis=1)
    if len(x) < size or not np.isfinite(x).all():
        return x
    powers = np.vander(np.arange(size) - half, min(3, max(1, size // 5)) + 1, increasing=True)
    fit = powers @ np.linalg.pinv(powers)  # row k: the weights that give the fitted value at place k of a window
    out = np.empty(len(x))
    out[half : len(x) - half] = np.lib.stride_tricks.sliding_window_view(x, size) @ fit[half]
    out[:half], out[len(x) - half :] = fit[:half] @ x[:size], fit[size - half :] @ x[-size:]
    return out


def hum_vector(t: np.ndarray, f: np.ndarray, nominal: float = 60.0) -> np.ndarray:
    """Mean deviation, deviation, least, largest, slope per minute; five NaN without a track."""
    if not len(f):
        return np.full(5, np.nan)
    x = t - t[0]
    spread = ((x - x.mean()) ** 2).sum()
    slope = ((x - x.mean()) * (f - f.mean())).sum() / spread if spread > 0 else 0.0
    return np.array([(f - nominal).mean(), f.std(), f.min(), f.max(), slope * 60])


def resample(y: np.ndarray, sr: int, target: int, half: int = 16) -> np.ndarray:
    """Windowed-sinc resampling; the cut-off is that of the lower rate."""
    if sr == target or not len(y):
        return y
    ratio = target / sr
    cutoff = min(1.0, ratio)
    at = np.arange(int(len(y) * ratio)) / ratio
    reach = int(math.ceil(half / cutoff))
    near = np.floor(at).astype(int)[:, None] + np.arange(-reach + 1, reach + 1)
    x = at[:, None] - near
    weights = cutoff * np.sinc(cutoff * x) * (0.5 + 0.5 * np.cos(np.pi * np.clip(x / reach, -1, 1)))
    inside = (near >= 0) & (near < len(y))
    return (np.where(inside, y[np.clip(near, 0, len(y) - 1)], 0.0) * weights).sum(axis=1)


def normalize_peak(y: np.ndarray) -> np.ndarray:
    return y / (np.abs(y).max() + 1e-9) if len(y) else y

"""Feature extraction as a Spark job: named extractors over an array column, with a status instead of an exception."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import dsp

FEATURE_VERSION = "1"


@dataclass(frozen=True)
class MfccConfig:
    n_mfcc: int = 20
    n_mels: int = 40
    fmin: float = 50.0
    second: bool = False

    @property
    def size(self) -> int:
        return self.n_mfcc * (6 if self.second else 4)

    def extract(self, y: np.ndarray, sr: int) -> np.ndarray:
        return dsp.mfcc_vector(y, sr, self.n_mfcc, self.second, n_mels=self.n_mels, fmin=self.fmin)


@dataclass(frozen=True)
class AmbientConfig:
    n_mels: int = 40
    n_fft: int = 1024
    hop: int = 160
    fmin: float = 50.0
    robust: bool = True
    quiet_percent: float = 30.0

    @property
    def size(self) -> int:
        return 2 * self.n_mels + 2

    def extract(self, y: np.ndarray, sr: int) -> np.ndarray:
        return dsp.ambient_vector(y, sr, self.n_mels, self.n_fft, self.hop, self.fmin, self.robust, self.quiet_percent)


@dataclass(frozen=True)
class HumConfig:
    nominal: float = 60.0
    bandwidth: float = 1.5
    strategy: str = "stft"
    between: bool = False
    smooth_sec: float = 0.25
    smooth_method: str = "savgol"

    size = 5

    def __post_init__(self) -> None:
        if self.strategy not in ("zc", "stft"):
            raise ValueError(f"unknown strategy {self.strategy}: zc or stft")
        if self.smooth_method not in ("savgol", "median"):
            raise ValueError(f"unknown smoothing {self.smooth_method}: savgol or median")

    def extract(self, y: np.ndarray, sr: int) -> np.ndarray:
        t, f = dsp.hum_zero_crossings(y, sr, self.nominal, self.bandwidth) if self.strategy == "zc" else dsp.hum_peaks(y, sr, self.nominal, self.bandwidth, between=self.between)
        if len(f) > 1:
            f = dsp.smooth(f, 1.0 / max(np.diff(t).mean(), 1e-6), self.smooth_sec, self.smooth_method)
        return dsp.hum_vector(t, f, self.nominal)


#: Parts of a vector, in their fixed order.
ORDER = (MfccConfig, AmbientConfig, HumConfig)


def config_hash(configs: list) -> str:
    """Ten characters that change with any setting or the version."""
    text = json.dumps({"version": FEATURE_VERSION, **{type(c).__name__: asdict(c) for c in configs}}, sort_keys=True)
    return hashlib.sha1(text.encode()).hexdigest()[:10]


def extract_features(clips: DataFrame, configs: list | None = None) -> DataFrame:
    """Per clip (path, y, sr): path, cfg_hash, vector, status (``ok`` or ``err: reason``).

    Parts stand in a fixed order, each of its own size; NaN becomes 0 and infinities 1e6. A clip that fails is a row with its reason.
    """
    parts = sorted(configs or [MfccConfig()], key=lambda c: ORDER.index(type(c)))
    stamp = config_hash(parts)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            vectors, states = [], []
            for y, sr in zip(pdf["y"], pdf["sr"], strict=True):
                try:
                    got = [np.resize(np.concatenate([c.extract(np.asarray(y, float), int(sr)), np.zeros(c.size)]), c.size) for c in parts]
                    vectors.append(np.nan_to_num(np.concatenate(got), nan=0.0, posinf=1e6, neginf=-1e6).astype(np.float32))
                    states.append("ok")
                except Exception as error:  # noqa: BLE001  a bad clip must not stop the job
                    vectors.append(None)
                    states.append(f"err: {error}")
            yield pd.DataFrame({"path": pdf["path"], "cfg_hash": stamp, "vector": vectors, "status": states})

    return clips.select("path", "y", "sr").mapInPandas(run, "path string, cfg_hash string, vector array<float>, status string")


def extract_missing(clips: DataFrame, store: DataFrame, configs: list) -> DataFrame:
    """Extracts what the store lacks under the present settings: a changed setting has another hash, and all is done anew."""
    held = store.filter((F.col("cfg_hash") == config_hash(sorted(configs, key=lambda c: ORDER.index(type(c))))) & (F.col("status") == "ok")).select("path")
    return extract_features(clips.join(held, "path", "left_anti"), configs)

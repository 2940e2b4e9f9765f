"""Numeric kernels on arrays of samples, in numpy; each runs in batches behind a pandas UDF."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

RATE, WINDOW, HOP, FFT, MELS, CEPSTRA = 16_000, 400, 160, 512, 26, 13


@lru_cache(8)
def _mel_bank(rate: int, fft: int, mels: int) -> np.ndarray:
    """Triangular filters [mels, bins], evenly spaced on the mel scale."""
    mel = lambda hz: 2595 * np.log10(1 + hz / 700)
    hz = 700 * (10 ** (np.linspace(0, mel(rate / 2), mels + 2) / 2595) - 1)
    edges = np.floor((fft + 1) * hz / rate)
    k = np.arange(fft // 2 + 1)[None]
    left, centre, right = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    up, down = (k - left) / np.maximum(centre - left, 1), (right - k) / np.maximum(right - centre, 1)
    return np.where((k >= left) & (k < centre), up, np.where((k >= centre) & (k < right), down, 0.0))


def framed(x: np.ndarray, window: int = WINDOW, hop: int = HOP) -> np.ndarray:
    """Overlapping frames [n, window]; none if the signal is shorter than one."""
    if len(x) < window:
        return np.zeros((0, window))
    return np.lib.stride_tricks.sliding_window_view(x, window)[::hop]


def mfcc(samples: np.ndarray, rate: int = RATE) -> np.ndarray:
    """Mel-frequency cepstral coefficients [frames, 13] less their mean; samples beyond 1 are read as 16-bit."""
    x = np.asarray(samples, float)
    if len(x) < WINDOW:
        return np.zeros((0, CEPSTRA))
    if np.abs(x).max() > 1:
        x = x / 32768
    x = np.append(x[0], x[1:] - 0.97 * x[:-1])
    power = np.abs(np.fft.rfft(framed(x) * np.hamming(WINDOW), FFT)) ** 2 / FFT
    energy = np.log(np.maximum(power @ _mel_bank(rate, FFT, MELS).T, 1e-12))
    basis = np.cos(np.pi * np.arange(CEPSTRA)[:, None] * (np.arange(MELS) + 0.5) / MELS)
    out = energy @ basis.T
    return out - out.mean(axis=0)


def flatness(frame: np.ndarray) -> float:
    """Spectral flatness: geometric by arithmetic mean of the power spectrum; 1 for noise, near 0 for a tone."""
    if not len(frame):
        return 0.0
    p = np.abs(np.fft.rfft(frame[:FFT] * np.hamming(min(len(frame), FFT)), FFT)) ** 2 + 1e-12
    return float(np.exp(np.log(p).mean()) / p.mean())


def local_cost(a: np.ndarray, b: np.ndarray, metric: str = "cosine") -> np.ndarray:
    """Distances [len(a), len(b)] of frames."""
    if metric == "cosine":
        na, nb = a / (np.linalg.norm(a, axis=1, keepdims=True) + 1e-10), b / (np.linalg.norm(b, axis=1, keepdims=True) + 1e-10)
        return np.clip(1 - na @ nb.T, 0, 2)
    return np.sqrt(np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T, 0))


def dtw(a: np.ndarray, b: np.ndarray, band: int = 15, metric: str = "cosine") -> float:
    """Warped distance by the sum of the lengths, along a band around the slope; without a band if none fits; infinite for an empty side.

    Cells are filled by anti-diagonals, whose cells don't depend on each other.
    """
    n, m = len(a), len(b)
    if not n or not m:
        return float("inf")
    cost = local_cost(np.asarray(a, float), np.asarray(b, float), metric)
    for limit in (band, None):
        D = np.full((n + 1, m + 1), np.inf)
        D[0, 0] = 0
        for s in range(2, n + m + 1):
            i = np.arange(max(1, s - m), min(n, s - 1) + 1)
            j = s - i
            if limit is not None:
                ok = np.abs(j - np.rint(i * m / n)) <= limit
                i, j = i[ok], j[ok]
            D[i, j] = cost[i - 1, j - 1] + np.minimum(np.minimum(D[i - 1, j - 1], D[i - 1, j]), D[i, j - 1])
        if np.isfinite(D[n, m]):
            return float(D[n, m] / (n + m))
    return float("inf")


def spotted(segment: np.ndarray, template: np.ndarray) -> float:
    """The warped distance of a template to a segment; in a segment of over 1.6 times its length, to the nearest window of 1.3 times it.

    Windows are a quarter of the template apart, three frames at least.
    """
    n, m = len(segment), len(template)
    if not n or not m or n <= 1.6 * m:
        return dtw(segment, template)
    size, step = max(1, int(1.3 * m)), max(3, m // 4)
    starts = {*range(0, n - size + 1, step), n - size}
    return min(dtw(segment[i : i + size], template) for i in starts)


def pitch(frame: np.ndarray, rate: int = RATE, low: float = 50, high: float = 500) -> float:
    """Fundamental frequency by the autocorrelation of the centre-clipped frame; nan where it is weak."""
    x = np.asarray(frame, float)
    if not len(x) or not np.abs(x).max() > 0:
        return float("nan")
    clip = 0.6 * np.abs(x).max()
    x = np.where(x > clip, x - clip, np.where(x < -clip, x + clip, 0))
    size = 1 << (2 * len(x) - 1).bit_length()
    r = np.fft.irfft(np.abs(np.fft.rfft(x, size)) ** 2)[: len(x)]
    lo, hi = int(rate / high), min(int(rate / low), len(x) - 2)
    if r[0] <= 0 or hi <= lo:
        return float("nan")
    k = lo + int(r[lo : hi + 1].argmax())
    if r[k] / r[0] < 0.35:
        return float("nan")
    bend = r[k - 1] - 2 * r[k] + r[k + 1]
    return rate / (k + (0.5 * (r[k - 1] - r[k + 1]) / bend if bend else 0))


def centroid(frame: np.ndarray, rate: int = RATE) -> float:
    """The mean frequency of the magnitude spectrum; 0 for silence."""
    mag = np.abs(np.fft.rfft(frame))
    return float((mag * np.fft.rfftfreq(len(frame), 1 / rate)).sum() / mag.sum()) if len(frame) and mag.sum() > 0 else 0.0


def resampled(samples: np.ndarray, rate: int, to: int = RATE) -> np.ndarray:
    """The signal at another rate, by linear interpolation."""
    n = int(len(samples) * to / rate)
    return np.interp(np.arange(n) * rate / to, np.arange(len(samples)), samples) if len(samples) else np.zeros(0)


@F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
def mfcc_of(samples: pd.Series) -> pd.Series:
    return samples.map(lambda x: None if x is None else [row.tolist() for row in mfcc(np.asarray(x))])


@F.pandas_udf(T.DoubleType())
def dtw_of(a: pd.Series, b: pd.Series) -> pd.Series:
    as_matrix = lambda x: np.array([np.asarray(r, float) for r in x]) if len(x) else np.zeros((0, 1))
    return pd.Series([float("nan") if x is None or y is None else dtw(as_matrix(x), as_matrix(y)) for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.DoubleType())
def spotted_of(segments: pd.Series, templates: pd.Series) -> pd.Series:
    """The least distance of an array of templates to each segment."""
    as_matrix = lambda x: np.array([np.asarray(r, float) for r in x]) if len(x) else np.zeros((0, 1))
    return pd.Series([float("nan") if s is None or t is None or not len(t) else min(spotted(as_matrix(s), as_matrix(x)) for x in t) for s, t in zip(segments, templates, strict=True)])


@F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in ("f0", "centroid", "flatness")]))
def voice_of(samples: pd.Series) -> pd.DataFrame:
    rows = [(pitch(x), centroid(np.asarray(x, float)), flatness(np.asarray(x, float))) if x is not None and len(x) else (None, None, None) for x in samples]
    return pd.DataFrame(rows, columns=["f0", "centroid", "flatness"])

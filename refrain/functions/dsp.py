"""Signal kernels in numpy (float32 samples in, features out), and their mapInPandas forms.

All frame kernels share one skeleton: hops while a whole window fits, a Hann window, the
magnitudes of the first half of the spectrum; a frame's time is its first sample's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Quantisation levels and band edges of the fingerprints.
QUARTILES = (0.25, 0.5, 0.75)
LEVELS = (0.1, 0.3, 0.6)
V2_LEVELS = (0.01, 0.05, 0.1, 0.2, 0.4, 0.6, 0.8)
V2_EDGES = (0.0, 100.0, 250.0, 500.0, 1000.0, 2000.0, 4000.0, 8000.0)


def hann(n: int, symmetric: bool = True) -> np.ndarray:
    return (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / (n - 1 if symmetric else n))).astype(np.float32)


def spectra(samples: np.ndarray, window: int, hop: int, peak: bool = False) -> np.ndarray:
    """Magnitudes (frame, window / 2); ``peak`` scales each frame's samples to a peak of 1 unless it is silent."""
    if len(samples) < window:
        return np.zeros((0, window // 2), np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(np.asarray(samples, np.float32), window)[::hop]
    if peak:
        top = np.abs(frames).max(axis=1, keepdims=True)
        frames = np.where(top > 1e-4, frames / np.maximum(top, 1e-30), frames)
    return np.abs(np.fft.rfft(frames * hann(window), axis=1))[:, : window // 2].astype(np.float32)


def mel(hz: float) -> float:
    return 2595.0 * np.log10(1 + hz / 700.0)


def mel_inverse(m: float) -> float:
    return 700.0 * (10 ** (m / 2595.0) - 1)


def mel_edges(bands: int, rate: float, bins: int) -> np.ndarray:
    """S-26: bin edges of ``bands`` equal mel steps from 0 to half the rate."""
    hz = mel_inverse(np.linspace(mel(0.0), mel(rate / 2), bands + 1))
    return np.minimum((hz / (rate / 2) * bins).astype(int), bins)


def band_levels(magnitudes: np.ndarray, edges: np.ndarray, mean: bool = True, normalise: bool = True) -> np.ndarray:
    """DSP-4: RMS (or root energy) of each band, divided by the frame's largest."""
    out = np.zeros((len(magnitudes), len(edges) - 1), np.float32)
    for b, (low, high) in enumerate(zip(edges, edges[1:], strict=False)):
        if high > low:
            energy = np.square(magnitudes[:, low:high]).sum(axis=1)
            out[:, b] = np.sqrt(energy / (high - low) if mean else energy)
    top = out.max(axis=1, keepdims=True, initial=0)
    return np.divide(out, top, out=np.zeros_like(out), where=top > 0) if normalise else out


def peaks(levels: np.ndarray, most: int = 8) -> list[tuple[int, float]]:
    """DSP-5: strict local maxima of a fifth of the largest level, the ``most`` strongest."""
    n, top = len(levels), levels.max(initial=0)
    found = []
    for i, x in enumerate(levels):
        left, right = levels[i - 1] if i else -np.inf, levels[i + 1] if i + 1 < n else -np.inf
        if x > 0 and x >= 0.2 * top and x > left and x > right:
            found.append((i, float(x)))
    return sorted(found, key=lambda p: (-p[1], p[0]))[:most]


def quartile(x: float) -> int:
    return sum(x >= q for q in QUARTILES)


def landmarks(samples: np.ndarray, rate: float, window: int = 4096, hop: int = 2048, bands: int = 12) -> list[tuple[float, int]]:
    """DSP-6: (time, hash) of each pair of peaks in neighbouring frames."""
    levels = band_levels(spectra(samples, window, hop), mel_edges(bands, rate, window // 2))
    found = [peaks(frame) for frame in levels]
    out = []
    for t in range(1, len(found)):
        out += [(t * hop / rate, b1 << 8 | quartile(e1) << 6 | b2 << 2 | quartile(e2)) for b1, e1 in found[t - 1] for b2, e2 in found[t]]
    return out


def mfcc(samples: np.ndarray, rate: float, window: int = 2048, hop: int = 512, bands: int = 40, kept: int = 13) -> np.ndarray:
    """DSP-7: unnormalised DCT-II of log mel energies (floor -23)."""
    levels = band_levels(spectra(samples, window, hop), mel_edges(bands, rate, window // 2))
    with np.errstate(divide="ignore"):
        logs = np.maximum(np.log(levels), -23.0)
    basis = np.cos(np.pi * np.outer(np.arange(kept), np.arange(bands) + 0.5) / bands)
    return (logs @ basis.T).astype(np.float32)


def delta_features(coefficients: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """DSP-8: slopes over +-2 frames (edges repeat), and their means over +-1."""
    n = len(coefficients)
    at = lambda a, k: a[np.clip(np.arange(n) + k, 0, n - 1)]
    slope = sum(k * at(coefficients, k) for k in (-2, -1, 1, 2)) / 6.0 if n else coefficients
    second = sum(at(slope, k) for k in (-1, 0, 1)) / 3.0 if n else slope
    return slope.astype(np.float32), second.astype(np.float32)


def centroid(magnitudes: np.ndarray) -> np.ndarray:
    """DSP-10: centre of mass of each spectrum, as a fraction of its bins."""
    total, n = magnitudes.sum(axis=1), magnitudes.shape[1]
    return np.where(total > 0, (magnitudes * np.arange(n)).sum(axis=1) / np.maximum(total, 1e-30) / n, 0)


def rolloff(magnitudes: np.ndarray, share: float = 0.85) -> np.ndarray:
    """DSP-10: the first bin up to which ``share`` of each spectrum's energy lies, as a fraction of the bins."""
    sums = np.cumsum(np.square(magnitudes, dtype=np.float64), axis=1)
    return (sums < share * sums[:, -1:]).sum(axis=1) / magnitudes.shape[1]


def spectral_hash(samples: np.ndarray, rate: float, window: int = 8192, hop: int = 2048) -> np.ndarray:
    """DSP-9: eight bands of three bits by mean magnitude, then four bits each of centroid (to 8 kHz) and rolloff."""
    m = spectra(samples, window, hop, peak=True)
    bins = np.minimum((np.append(V2_EDGES, rate / 2) / (rate / 2) * m.shape[1]).astype(int), m.shape[1])
    out = np.zeros(len(m), np.int64)
    for b, (low, high) in enumerate(zip(bins, bins[1:], strict=False)):
        level = m[:, low:high].sum(axis=1) / max(high - low, 1)
        out |= np.digitize(level, V2_LEVELS).astype(np.int64) << (3 * b)
    out |= np.minimum(centroid(m) * (rate / 2) / 8000.0 * 15.0, 15.0).astype(np.int64) << 24
    return out | np.minimum(rolloff(m) * 15.0, 15.0).astype(np.int64) << 28


def energy_bands(samples: np.ndarray, rate: float, window: int = 4096, hop: int = 1024, bands: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """DSP-11: band levels, their RMS, and the mean change from the frame before."""
    levels = band_levels(spectra(samples, window, hop), mel_edges(bands, rate, window // 2))
    flux = np.abs(np.diff(levels, axis=0, prepend=levels[:1])).mean(axis=1) if len(levels) else np.zeros(0)
    return levels, np.sqrt(np.square(levels).mean(axis=1)), flux


def mel_fingerprint(samples: np.ndarray, rate: float, window: int = 4096, bands: int = 12) -> np.ndarray:
    """DSP-12: quantised mel levels of the first window; zeros for shorter input."""
    m = spectra(samples[:window], window, window)
    if not len(m):
        return np.zeros(bands, np.int32)
    return np.digitize(band_levels(m, mel_edges(bands, rate, window // 2), mean=False)[0], LEVELS).astype(np.int32)


def spectral_features(samples: np.ndarray, rate: float, window: int = 8192, hop: int | None = None, kept: int = 8) -> list[tuple[float, float, float, list[int], float]]:
    """DSP-1: (time, centroid Hz, rolloff Hz, strongest bins, energy) of each frame; peak-normalised."""
    hop = hop or window
    m = spectra(samples, window, hop, peak=True)
    hz = rate / 2
    out = []
    for t, (row, c, r) in enumerate(zip(m, centroid(m), rolloff(m), strict=True)):
        strongest = np.lexsort((np.arange(len(row)), -row))[:kept]
        out.append((t * hop / rate, float(c * hz), float(r * hz), strongest.tolist(), float(np.sqrt(np.square(row).sum() / len(row)))))
    return out


def class_hash(centroid_hz: Column, energy: Column, bins: Column) -> Column:
    """DSP-2: frequency class, energy class, and whether a strong bin lies under 50."""
    freq = F.when(centroid_hz < 1500, 0).when(centroid_hz < 4000, 1).otherwise(2)
    loud = F.when(energy < 3, 0).when(energy < 8, 1).when(energy < 15, 2).otherwise(3)
    low = F.when(F.exists(bins, lambda b: b < 50), 1).otherwise(0)
    return (freq * 16 + loud * 4 + low).cast("long")


def _frames(samples: DataFrame, kernel: Callable[[np.ndarray, float], list[tuple]], fields: str) -> DataFrame:
    """Apply a kernel to (episode_id, sample_rate, samples) rows; ``fields`` follow episode_id and frame_idx."""
    names = ["episode_id", "frame_idx", *[f.split()[0] for f in fields.split(", ")]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for ep, rate, values in zip(batch["episode_id"], batch["sample_rate"], batch["samples"], strict=True):
                rows = kernel(np.asarray([] if values is None else values, np.float32), float(rate))
                yield pd.DataFrame([(ep, i, *r) for i, r in enumerate(rows)], columns=names)

    return samples.select("episode_id", "sample_rate", "samples").mapInPandas(run, f"episode_id int, frame_idx int, {fields}")


def landmark_frames(samples: DataFrame) -> DataFrame:
    return _frames(samples, landmarks, "ts double, hash int")


def mfcc_frames(samples: DataFrame) -> DataFrame:
    def kernel(x: np.ndarray, rate: float) -> list[tuple]:
        c = mfcc(x, rate)
        d, dd = delta_features(c)
        return [(i * 512 / rate, a.tolist(), b.tolist(), e.tolist()) for i, (a, b, e) in enumerate(zip(c, d, dd, strict=True))]

    return _frames(samples, kernel, "ts double, coefficients array<float>, deltas array<float>, delta_deltas array<float>")


def energy_frames(samples: DataFrame) -> DataFrame:
    def kernel(x: np.ndarray, rate: float) -> list[tuple]:
        return [(i * 1024 / rate, b.tolist(), float(r), float(f)) for i, (b, r, f) in enumerate(zip(*energy_bands(x, rate), strict=True))]

    return _frames(samples, kernel, "ts double, bands array<float>, rms_energy float, flux float")


def spectral_hash_frames(samples: DataFrame) -> DataFrame:
    return _frames(samples, lambda x, rate: [(i * 2048 / rate, int(h)) for i, h in enumerate(spectral_hash(x, rate))], "ts double, hash long")


def legacy_frames(samples: DataFrame, frame_rate: float = 1.0) -> DataFrame:
    """DSP-3: the legacy hash stream at ``frame_rate`` frames a second."""
    rows = _frames(samples, lambda x, rate: spectral_features(x, rate, hop=int(rate / frame_rate)), "ts double, centroid double, rolloff double, dominant_bins array<int>, energy double")
    return rows.select("episode_id", "frame_idx", "ts", class_hash(F.col("centroid"), F.col("energy"), F.col("dominant_bins")).alias("hash"))

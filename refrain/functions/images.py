"""Image features in numpy, for frames that arrive as pixels, and the alignment of feature sequences.

Images are grey (height, width) or colour (height, width, 3) arrays of 0-255; resizing to the
hash sizes is the source's job.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# Grid step, gradient threshold and patch reach of the keypoints.
GRID, CORNER, REACH = 32, 10.0, 2
MASK = (1 << 64) - 1


def color_hash(pixels: np.ndarray) -> int:
    """S-8 of an 8 x 8 colour image: a multiplicative hash of which channels exceed their integer means, as a signed word."""
    flat = np.asarray(pixels, np.int64).reshape(-1, 3)
    codes = ((flat > flat.sum(axis=0) // len(flat)) * np.array([1, 2, 4])).sum(axis=1)
    h = 0
    for c in codes.tolist():
        h = (h * 31 & MASK) | c
    return h - (1 << 64) if h >> 63 else h


def bits(flags: np.ndarray) -> int:
    h = int(sum(1 << i for i in np.flatnonzero(np.ravel(flags)).tolist()))
    return h - (1 << 64) if h >> 63 else h


def multi_scale_hash(grey9x8: np.ndarray, grey8x8: np.ndarray, color8x8: np.ndarray, placeholder: int) -> dict[str, int]:
    """S-9: the four hashes of a frame; ``placeholder`` is the source's S-5."""
    wide, small = np.asarray(grey9x8, np.int64), np.asarray(grey8x8, np.int64)
    return {"dhash": bits(wide[:, :-1] > wide[:, 1:]), "phash": placeholder, "ahash": bits(small > small.sum() // small.size), "color_hash": color_hash(color8x8)}


@dataclass
class FrameFeatures:
    """S-13: block signature, grid keypoints (x, y, response) with 5 x 5 patches, and the frame's time."""

    ts: float
    signature: np.ndarray
    keypoints: np.ndarray = field(default_factory=lambda: np.zeros((0, 3)))
    patches: np.ndarray = field(default_factory=lambda: np.zeros((0, 25)))


def keypoints(grey: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """S-12: grid points where the central difference is strong, and their patches."""
    g = np.asarray(grey, float)
    height, width = g.shape
    found, patches = [], []
    for y in range(GRID, height - GRID, GRID):
        for x in range(GRID, width - GRID, GRID):
            response = float(np.hypot(g[y, x + 1] - g[y, x - 1], g[y + 1, x] - g[y - 1, x]))
            if response > CORNER:
                found.append((x, y, response))
                patches.append(g[y - REACH : y + REACH + 1, x - REACH : x + REACH + 1].ravel() / 255)
    return np.array(found).reshape(-1, 3), np.array(patches).reshape(-1, (2 * REACH + 1) ** 2)


def block_signature(grey64: np.ndarray) -> np.ndarray:
    """S-11: mean/255 and variance/255**2 of the 8 x 8 blocks of a 64 x 64 image."""
    blocks = np.asarray(grey64, float).reshape(8, 8, 8, 8).swapaxes(1, 2).reshape(64, 64)
    return np.column_stack([blocks.mean(axis=1) / 255, blocks.var(axis=1) / 255**2]).ravel()


def frame_features(ts: float, grey: np.ndarray, grey64: np.ndarray) -> FrameFeatures:
    return FrameFeatures(ts, block_signature(grey64), *keypoints(grey))


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    norms = np.linalg.norm(a) * np.linalg.norm(b) if len(a) == len(b) else 0.0
    return float(a @ b / norms) if norms > 0 else 0.0


def match_keypoints(a: FrameFeatures, b: FrameFeatures) -> float:
    """S-17: 0.9 times the share of keypoints matched and the mean similarity of their best partners; 0 when few or weak."""
    n1, n2 = len(a.patches), len(b.patches)
    if not n1 or not n2:
        return 0.0
    norms = np.outer(np.linalg.norm(a.patches, axis=1), np.linalg.norm(b.patches, axis=1))
    best = np.divide(a.patches @ b.patches.T, norms, out=np.zeros_like(norms), where=norms > 0).max(axis=1)
    matched = best[best > 0]
    ratio = len(matched) / max(n1, n2)
    mean = float(matched.mean()) if len(matched) else 0.0
    return 0.0 if ratio < 0.2 or mean < 0.5 else ratio * mean * 0.9


def frame_similarity(a: FrameFeatures, b: FrameFeatures) -> float:
    return 0.6 * cosine(a.signature, b.signature) + 0.4 * match_keypoints(a, b)


def align(one: list[FrameFeatures], two: list[FrameFeatures], max_shift: int) -> tuple[tuple[float, float], tuple[float, float], float] | None:
    """S-18: the shift of either sequence, up to ``max_shift``, with the best mean similarity of every third pair.

    At least ten frames have to overlap; the first of equal shifts wins. Returns both time ranges and the mean.
    """
    best = None
    for flipped, (a, b) in enumerate(((one, two), (two, one))):
        for shift in range(min(max_shift, len(a) - 1) + 1 if a and b else 0):
            n = min(len(a) - shift, len(b))
            if n < 10:
                continue
            mean = float(np.mean([frame_similarity(a[shift + i], b[i]) for i in range(0, n, 3)]))
            if mean > (best[2] if best else 0.0):
                ranges = ((a[shift].ts, a[shift + n - 1].ts), (b[0].ts, b[n - 1].ts))
                best = (*(ranges[::-1] if flipped else ranges), mean)
    return best


ALIGNED = "ep1 long, ep2 long, start1 double, end1 double, start2 double, end2 double, score double"


def align_pairs(pairs: DataFrame, max_shift: int) -> DataFrame:
    """S-18 for rows (ep1, ep2, f1, f2) whose f's are arrays of (ts, signature) in time order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for e1, e2, f1, f2 in zip(batch["ep1"], batch["ep2"], batch["f1"], batch["f2"], strict=True):
                found = align(*[[FrameFeatures(x["ts"], np.asarray(x["signature"], float)) for x in f] for f in (f1, f2)], max_shift)
                if found:
                    rows.append((e1, e2, *found[0], *found[1], found[2]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ALIGNED.split(", ")])

    return pairs.select("ep1", "ep2", "f1", "f2").mapInPandas(run, ALIGNED)

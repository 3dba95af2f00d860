"""Scores of all pairs of two blocks of windows, for joins whose pairs are too many to be rows.

A kernel has Spark columns that say which values it takes (``valid``) and which of them may meet
(``shape``), and loads a block of values into arrays. ``order`` is a matrix of scores, smaller
being better, that may be off by ``slack``; ``exact`` gives scores of single pairs, which depend
on the two values alone and not on their places in a block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .hashing import synthetic_signature

Block = dict[str, np.ndarray]


def take(block: Block, rows) -> Block:
    return {k: v[rows] for k, v in block.items()}


class Words:
    """S-3 of 64-bit words: 1 - distance / 64, the largest first."""

    largest = True

    def valid(self, values: Column) -> Column:
        return values.isNotNull()

    def shape(self, values: Column) -> Column:
        return F.lit("")

    def load(self, values: pa.Array) -> Block:
        return {"word": values.to_numpy(zero_copy_only=False).astype(np.int64, copy=False).view(np.uint64)}

    def keys(self, block: Block) -> np.ndarray:
        return block["word"]

    def order(self, a: Block, b: Block) -> np.ndarray:
        return np.bitwise_count(a["word"][:, None] ^ b["word"][None, :])

    def slack(self, a: Block, b: Block) -> float:
        return 0

    def exact(self, a: Block, b: Block) -> np.ndarray:
        return 1 - np.bitwise_count(a["word"] ^ b["word"]) / 64.0


class _Frames:
    """Windows that are arrays of structs with arrays of numbers (``vectors``) and numbers (``numbers``); scores are means over frames."""

    largest = False
    vectors: tuple[str, ...] = ()
    numbers: tuple[str, ...] = ()

    def valid(self, values: Column) -> Column:
        whole = lambda v: F.coalesce(F.forall(v, lambda x: x.isNotNull()), F.lit(False))

        def known(frame: Column) -> Column:
            out = frame.isNotNull()
            for name in self.vectors:
                out = out & whole(frame[name])
            for name in self.numbers:
                out = out & frame[name].isNotNull()
            return out

        return (F.size(values) > 0) & F.forall(values, known)

    def shape(self, values: Column) -> Column:
        return F.transform(values, lambda v: F.array(*[F.size(v[name]) for name in self.vectors])).cast("string")

    def _read(self, values: pa.Array) -> tuple[list[np.ndarray], dict[str, np.ndarray]]:
        """(window, frame, component) of each vector, and (window, frame) of each number."""
        n, frames = len(values), values.flatten()
        as_doubles = lambda x: x.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
        per = len(frames) // n
        vectors = [as_doubles(frames.field(name).flatten()) for name in self.vectors]
        return [v.reshape(n, per, len(v) // (n * per)) for v in vectors], {name: as_doubles(frames.field(name)).reshape(n, per) for name in self.numbers}

    def keys(self, block: Block) -> np.ndarray:
        """Numbers that are equal for equal windows."""
        seen: dict[bytes, int] = {}
        flat = np.concatenate([v.reshape(len(v), -1) for v in block.values()], axis=1)
        return np.array([seen.setdefault(row.tobytes(), len(seen)) for row in flat], np.int64)


class MfccDistance(_Frames):
    """DSP-13: weighted distances of coefficients, deltas and second deltas, the smallest first."""

    vectors = ("coefficients", "deltas", "delta_deltas")
    weights = (1.0, 0.5, 0.25)

    def load(self, values: pa.Array) -> Block:
        vectors, _ = self._read(values)
        return {"x": np.concatenate([v * w**0.5 for v, w in zip(vectors, self.weights, strict=True)], axis=2)}

    def order(self, a: Block, b: Block) -> np.ndarray:
        out = np.zeros((len(a["x"]), len(b["x"])))
        for f in range(a["x"].shape[1]):
            x, y = a["x"][:, f], b["x"][:, f]
            d = x @ y.T
            d *= -2
            d += (x * x).sum(axis=1)[:, None]
            d += (y * y).sum(axis=1)[None, :]
            out += np.sqrt(np.maximum(d, 0, out=d), out=d)
        return out / a["x"].shape[1]

    def slack(self, a: Block, b: Block) -> float:
        """The root of what is lost by cancellation, which is in proportion to the longest vectors."""
        longest = max((float(np.nanmax(np.where(np.isfinite(s := (x * x).sum(axis=2)), s, 0.0), initial=0.0)) for x in (a["x"], b["x"])), default=0.0)
        return 2e-6 * longest**0.5

    def exact(self, a: Block, b: Block) -> np.ndarray:
        d = a["x"] - b["x"]
        d *= d
        return np.sqrt(d.sum(axis=2)).sum(axis=1) / d.shape[1]


class EnergyCorrelation(_Frames):
    """DSP-14: cosines of bands and ratios of energy, the largest first."""

    largest = True
    vectors, numbers = ("bands",), ("rms_energy",)

    def load(self, values: pa.Array) -> Block:
        (x,), numbers = self._read(values)
        return {"x": x, "rms": numbers["rms_energy"]}

    @staticmethod
    def _score(dots: np.ndarray, norms: np.ndarray, r1: np.ndarray, r2: np.ndarray) -> np.ndarray:
        high = np.maximum(r1, r2)
        with np.errstate(all="ignore"):
            loud = np.where(high > 0, np.minimum(r1, r2) / high, 0.0)
            return np.where(norms < 1e-6, 0.0, 0.8 * dots / norms + 0.2 * loud)

    def order(self, a: Block, b: Block) -> np.ndarray:
        out = np.zeros((len(a["x"]), len(b["x"])))
        for f in range(a["x"].shape[1]):
            x, y = a["x"][:, f], b["x"][:, f]
            norms = np.sqrt((x * x).sum(axis=1))[:, None] * np.sqrt((y * y).sum(axis=1))[None, :]
            out -= self._score(x @ y.T, norms, a["rms"][:, f][:, None], b["rms"][:, f][None, :])
        return out / a["x"].shape[1]

    def slack(self, a: Block, b: Block) -> float:
        return 1e-9

    def exact(self, a: Block, b: Block) -> np.ndarray:
        x, y = a["x"], b["x"]
        norms = np.sqrt((x * x).sum(axis=2)) * np.sqrt((y * y).sum(axis=2))
        return self._score((x * y).sum(axis=2), norms, a["rms"], b["rms"]).sum(axis=1) / x.shape[1]


class Signatures:
    """0.6 of signature similarity and 0.4 of keypoint agreement (S-25, S-17) of arrays of words, as means over frames; sums are in the order of the column expressions."""

    def value(self, words: Column) -> Column:
        return F.struct(F.flatten(F.transform(words, synthetic_signature)).alias("sig"), F.transform(words, lambda h: F.bit_count(h.bitwiseAND(F.lit(255)))).alias("points"))

    def load(self, values: pa.Array) -> Block:
        n = len(values)
        sig = values.field("sig").flatten().to_numpy(zero_copy_only=False).reshape(n, -1, 4)
        squares = np.zeros(sig.shape[:2])
        for c in range(4):
            squares += sig[:, :, c] * sig[:, :, c]
        return {"sig": sig, "norm": np.sqrt(squares), "points": values.field("points").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)}

    def scores(self, a: Block, b: Block) -> np.ndarray:
        one, two = np.arange(9.0)[:, None], np.arange(9.0)[None, :]
        ratio = one / np.maximum(np.maximum(one, two), 1)
        agreement = 0.4 * np.where((one > 0) & (two > 0) & (ratio >= 0.2), 0.9 * ratio, 0.0)
        frames = a["norm"].shape[1]
        out = np.zeros((len(a["norm"]), len(b["norm"])))
        for f in range(frames):
            x, y = a["sig"][:, f], b["sig"][:, f]
            dots = np.zeros_like(out)
            for c in range(4):
                dots += x[:, c, None] * y[None, :, c]
            norms = a["norm"][:, f, None] * b["norm"][None, :, f]
            if not norms.all():
                dots[norms == 0], norms[norms == 0] = 0.0, 1.0
            dots /= norms
            dots *= 0.6
            dots += agreement[a["points"][:, f]][:, b["points"][:, f]]
            out += dots
        return out / frames

"""Incremental window hashing and sessions over streams of frames."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.hashing import MODULUS, PRIME

OUT = "episode_id long, frame_idx long, hash long, start_time double, end_time double"


class RollingHash:
    """STR-1: the hash of the last ``width`` words; None until there are as many."""

    def __init__(self, width: int, values: list[int] | None = None):
        self.width, self.values = width, list(values or [])

    def add(self, value: int) -> int | None:
        self.values = [*self.values, value & (1 << 64) - 1][-self.width :]
        if len(self.values) < self.width:
            return None
        h = 0
        for v in self.values:
            h = ((h * PRIME + v) & (1 << 64) - 1) % MODULUS
        return h

    def reset(self) -> None:
        self.values = []


def stream_rolling_hash(frames: DataFrame, width: int) -> DataFrame:
    """The rolling hash of a stream of frames (episode_id, frame_idx, ts, hash); state is each sequence's last ``width`` - 1 words.

    Frames of a sequence arrive in order between micro-batches; inside one they are sorted.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        words, times = state.get if state.exists else ([], [])
        roll, times = RollingHash(width, list(words)), list(times)
        out = []
        rows = pd.concat(list(batches)).sort_values("frame_idx")
        for i, t, h in zip(rows["frame_idx"], rows["ts"], rows["hash"], strict=True):
            times = [*times, float(t)][-width:]
            made = roll.add(int(h))
            if made is not None:
                out.append((key[0], int(i), made, times[0], float(t)))
        signed = [v - (1 << 64) if v >= 1 << 63 else v for v in roll.values]
        state.update((signed, times))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    return frames.groupBy("episode_id").applyInPandasWithState(step, OUT, "words array<long>, times array<double>", "append", GroupStateTimeout.NoTimeout)


def stream_sessions(frames: DataFrame, gap: str = "2 seconds", late: str = "1 minute") -> DataFrame:
    """STR-6: sessions of a stream with an event time column ``event_time``; late rows are taken for ``late``."""
    window = F.session_window("event_time", gap)
    return frames.withWatermark("event_time", late).groupBy("episode_id", window).agg(F.count("*").alias("n"), F.min("frame_idx").alias("start_frame"), F.max("frame_idx").alias("end_frame"))


def stream_recurrence(hashes: DataFrame, every: str = "1 hour", late: str = "10 minutes", threshold: int = 3) -> DataFrame:
    """Window hashes that show up in ``threshold`` or more rows, and sequences, of an hour, from a stream with ``event_time``."""
    counted = hashes.withWatermark("event_time", late).groupBy(F.window("event_time", every), "hash").agg(F.count("*").alias("n"), F.approx_count_distinct("episode_id").alias("episodes"))
    return counted.filter((F.col("n") >= threshold) & (F.col("episodes") >= threshold))

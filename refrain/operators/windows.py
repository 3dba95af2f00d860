"""Sequence windows: rolling hashes, sessions, sampled positions, lagged differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hamming, rotate_left, window_hash

#: Frames of a window that are had one by one; wider windows are had as lists, which cost more a frame.
LAGS = 16


def _order(key: str = "episode_id") -> Window:
    return Window.partitionBy(key).orderBy("frame_idx")


def series_of(df: DataFrame) -> list[str]:
    """``["series"]`` where a table has that column: the series a sequence belongs to, outside of which it meets no other."""
    return [c for c in df.columns if c == "series"]


def _windows(frames: DataFrame, widths: list[int]) -> DataFrame:
    """A row per full window of each width, all widths in one pass over the frames."""
    window, most = _order(), min(max(widths), LAGS)
    starts = [F.lag("ts", k - 1).over(window).alias(f"start{k}") for k in widths]
    words = [F.lag("hash", i).over(window).alias(f"word{i}") for i in range(most) if min(widths) <= LAGS]
    lists = [F.collect_list("hash").over(window.rowsBetween(1 - k, 0)).alias(f"list{k}") for k in widths if k > LAGS]
    rows = frames.select("episode_id", "frame_idx", F.col("ts").alias("end_time"), *series_of(frames), *starts, *words, *lists)

    def full(k: int) -> Column:
        """The words of a window; null unless all are there."""
        if k > LAGS:
            return F.when(F.size(f"list{k}") == k, F.col(f"list{k}"))
        last = [F.col(f"word{i}") for i in reversed(range(k))]
        return F.when(reduce(Column.__and__, [c.isNotNull() for c in last]), F.array(*last))

    made = [F.struct(full(k).alias("w"), F.col(f"start{k}").alias("start_time")) for k in widths]
    kept = rows.select("episode_id", "frame_idx", "end_time", *series_of(frames), *([F.inline(F.array(*made))] if made[1:] else [made[0]["w"].alias("w"), made[0]["start_time"].alias("start_time")]))
    return kept.filter("w IS NOT NULL").select(window_hash(F.col("w")).alias("hash"), "episode_id", "frame_idx", "start_time", "end_time", *series_of(frames))


def rolling_hash(frames: DataFrame, width: int) -> DataFrame:
    """WIN-1: a row per full window of ``width`` frames (seq_hashes): hash, episode_id, frame_idx of its end, start_time, end_time, and the series if there is one."""
    return _windows(frames, [width])


def with_opening_window(frames: DataFrame, width: int, opening: int = 3) -> DataFrame:
    """WIN-2: windows of ``width`` and, when shorter, of the opening width."""
    return _windows(frames, [width, opening] if opening < width else [width])


def analysis_vector(frames: DataFrame, width: int = 5) -> DataFrame:
    """WIN-3, WIN-4: the rolling hash where a window is full, the frame's own hash before."""
    values = F.collect_list("hash").over(_order().rowsBetween(1 - width, 0))
    return frames.withColumn("w", values).select("episode_id", "frame_idx", F.when(F.size("w") == width, window_hash(F.col("w"))).otherwise(F.col("hash")).alias("value"))


def vector_windows(frames: DataFrame, value: str, width: int, stride: int) -> DataFrame:
    """WIN-6: (episode_id, pos, start_time, end_time, values) of every ``stride``-th window; the last start is below n - width.

    Frames with a ``region`` (and ``whole``) are numbered anew in each, so that no window crosses from one into another.
    """
    inside = Window.partitionBy("episode_id", *(["region"] if "region" in frames.columns else []))
    order = inside.orderBy("frame_idx")
    ahead, n = order.rowsBetween(0, width - 1), F.count("*").over(inside)
    kept = [c for c in ("region", "whole", "series") if c in frames.columns]
    pos = F.row_number().over(order) - 1 if "region" in kept else F.col("frame_idx")
    rows = frames.select("episode_id", pos.alias("pos"), F.col("ts").alias("start_time"), F.last("ts").over(ahead).alias("end_time"), F.collect_list(value).over(ahead).alias("values"), n.alias("n"), *kept)
    return rows.filter((F.col("pos") % stride == 0) & (F.col("pos") < F.col("n") - width)).drop("n")


def sessions(frames: DataFrame, gap: float = 2.0) -> DataFrame:
    """WIN-7: scenes, cut where consecutive frames are more than ``gap`` seconds apart, with S-19's complexity."""
    window = _order()
    cut = (F.col("ts") - F.lag("ts").over(window)) > gap
    marked = frames.withColumn("scene", F.sum(F.when(cut, 1).otherwise(0)).over(window.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy("episode_id", "scene").orderBy("frame_idx")
    steps = marked.withColumn("d", hamming(F.col("hash"), F.lag("hash").over(inside)))
    return steps.groupBy("episode_id", "scene").agg(
        F.min("frame_idx").alias("start_frame"),
        F.max("frame_idx").alias("end_frame"),
        F.min("ts").alias("start_time"),
        F.max("ts").alias("end_time"),
        (F.coalesce(F.avg("d"), F.lit(0.0)) / 64).alias("complexity"),
    )


def identity_sample(frames: DataFrame) -> DataFrame:
    """WIN-8: all frames of short sequences (30 at most), else ten from the start, the middle and the end."""
    n = F.count("*").over(Window.partitionBy("episode_id"))
    half = F.floor(F.col("n") / 2)
    i = F.col("frame_idx")
    return frames.withColumn("n", n).filter((F.col("n") <= 30) | (i < 10) | (i >= F.col("n") - 10) | i.between(half - 5, half + 4))


def lag_statistics(frames: DataFrame) -> DataFrame:
    """WIN-9: per sequence the mean change between neighbours (complexity), its mean share of 64 bits moved twice in a row (motion), and the spread of colour bits."""
    window = _order()
    d = hamming(F.col("hash"), F.lag("hash").over(window))
    color = F.bit_count(rotate_left(F.col("hash"), 3).bitwiseXOR(F.lit(0x3333333333333333))) / 64.0
    steps = frames.select("episode_id", "frame_idx", d.alias("d"), color.alias("color"))
    steps = steps.withColumn("dd", F.abs(F.col("d") - F.lag("d").over(window)))
    return steps.groupBy("episode_id").agg(
        (F.coalesce(F.avg("d"), F.lit(0.0)) / 64).alias("complexity"), (F.coalesce(F.avg("dd"), F.lit(0.0)) / 64).alias("motion"), F.coalesce(F.var_pop("color"), F.lit(0.0)).alias("color_variance"), F.count("*").alias("n")
    )


def centred(frames: DataFrame, value: str, reach: int) -> DataFrame:
    """WIN-10: the 2 * reach + 1 values around each frame; beyond the ends the first or last one repeats."""
    every = Window.partitionBy("episode_id").orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    window = _order()

    def at(k: int) -> Column:
        if k == 0:
            return F.col(value)
        shifted = F.lag(value, -k).over(window) if k < 0 else F.lead(value, k).over(window)
        return F.coalesce(shifted, (F.first(value) if k < 0 else F.last(value)).over(every))

    return frames.withColumn("around", F.array(*[at(k) for k in range(-reach, reach + 1)]))


def deltas(frames: DataFrame, value: str) -> DataFrame:
    """DSP-8 on a scalar: regression slope over +-2 frames, and its mean over +-1."""
    first = centred(frames, value, 2)
    k = [-2, -1, 0, 1, 2]
    slope = sum((F.get("around", F.lit(i)) * w for i, w in enumerate(k)), F.lit(0.0)) / 6.0
    second = centred(first.withColumn("delta", slope).drop("around"), "delta", 1)
    return second.withColumn("delta_delta", F.aggregate("around", F.lit(0.0), lambda a, x: a + x) / 3.0).drop("around")

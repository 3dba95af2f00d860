"""Detectors: plans over frames, vectors or samples of series of sequences.

Video detectors take ``frames`` (episode_id, frame_idx, ts, hash), audio detectors the
feature tables of :mod:`refrain.functions.dsp`; ``episodes`` is (episode_id, name) and, where a
table holds several series, ``series``. Sequences meet those of their own series only, and
each series has its own segments, fallbacks included; without the column, and for sequences
that ``episodes`` doesn't have, the series is 0. Sequence ids are unique over all series.
What a detector derives from its input beside that (window width, adaptive threshold) is the
whole table's. Each returns ``segments`` rows with a ``series`` column. Joins, windows and
counts are distributed; what a fold gets are the matches or groups left of one series.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DetectConfig, window_size
from ..functions import kernels
from ..functions.hashing import synthetic_signature
from ..functions.similarity import adaptive_threshold, confidence, cosine, keypoint_match
from ..operators import folds, intervals, joins, windows
from ..operators.components import components
from ..operators.folds import Match, Segment
from ..operators.windows import series_of
from ..storage import materialize

#: Whole sequences that a task compares with as many others.
SEQUENCES = 32
SEGMENTS = f"series long, {folds.SEGMENT_SCHEMA}"


def _series(table: DataFrame) -> Column:
    return F.coalesce(F.col("series").cast("long"), F.lit(0).cast("long")) if series_of(table) else F.lit(0).cast("long")


def _names(episodes: DataFrame) -> DataFrame:
    return episodes.select(F.col("episode_id").cast("long").alias("ep"), F.coalesce("name", F.lit("unknown")).alias("name"), _series(episodes).alias("series"))


def in_series(rows: DataFrame, episodes: DataFrame) -> DataFrame:
    """``rows`` of sequences with their series, as ``episodes`` has it."""
    rows = rows.drop("series")
    if not series_of(episodes):
        return rows.withColumn("series", F.lit(0).cast("long"))
    known = _names(episodes).select(F.col("ep").alias("episode_id"), "series")
    return rows.join(known.hint("merge"), "episode_id", "left").withColumn("series", F.coalesce("series", F.lit(0).cast("long")))


def _or_else(found: DataFrame, frames: DataFrame, fallback: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``found``, and what ``fallback`` finds in series without any. Written, since it is read twice."""
    found = materialize(found, "found", tidy=True)
    done = found.select("series").distinct()
    if done.isEmpty():
        return fallback(frames)
    # Asked of the series alone first, which mostly needs no more of the frames than their ids.
    if frames.select("series").distinct().join(done.hint("merge"), "series", "left_anti").isEmpty():
        return found
    rest = materialize(frames.join(done.hint("merge"), "series", "left_anti"), "rest", tidy=True)
    return found.unionByName(fallback(rest))


def _ordered(segments: DataFrame) -> DataFrame:
    """SRT-1: by confidence, then start, in each series."""
    return segments.orderBy("series", F.desc("confidence"), "start_time")


def _rows(df: DataFrame, kind: str, start: str, end: str, names: str, value: str) -> DataFrame:
    """``segments`` rows from columns of ``df``."""
    sides = {"video": value if kind != "audio" else None, "audio": value if kind != "video" else None}
    return df.select(
        _series(df).alias("series"),
        F.col(start).cast("double").alias("start_time"),
        F.col(end).cast("double").alias("end_time"),
        F.col(names).alias("episode_list"),
        F.lit(None).cast("array<struct<episode_name:string,start_time:double,end_time:double>>").alias("episode_timings"),
        F.col(value).cast("double").alias("confidence"),
        *[(F.col(v).cast("double") if v else F.lit(None).cast("double")).alias(f"{side}_confidence") for side, v in sides.items()],
        F.lit(kind).alias("match_type"),
    )


def hash_groups(hashes: DataFrame, threshold: int, key: str = "hash", min_duration: float = 0.0) -> DataFrame:
    """AGG-1, AGG-2, FLT-1: groups of equal keys (in a series) in at least ``threshold`` rows and distinct sequences, with S-21's confidence."""
    d = F.col("end_time") - F.col("start_time")
    out = hashes.groupBy(key, *series_of(hashes)).agg(
        F.count("*").alias("n"),
        F.avg("start_time").alias("start_time"),
        F.avg(d).alias("duration"),
        F.var_pop(d).alias("variance"),
        F.array_sort(F.collect_set("episode_id")).alias("episodes"),
    ).withColumn("n_episodes", F.size("episodes").cast("long"))
    out = out.filter((F.col("n") >= threshold) & (F.col("n_episodes") >= threshold) & (F.col("duration") >= min_duration))
    return out.withColumns({"end_time": F.col("start_time") + F.col("duration"), "confidence": confidence(F.col("variance"), F.col("n"))}).drop("variance")


def similarity_groups(hashes: DataFrame, threshold: int, key: str, min_duration: float = 0.0) -> DataFrame:
    """AGG-3, FLT-1: from the first start to the last end of each group, with its members' mean pairwise similarity (0 of a single one).

    A bit that c of n members have set tells c (n - c) pairs apart, so counts of bits stand for the pairs.
    """
    n = F.col("n").cast("double")
    ones = [F.sum(F.shiftrightunsigned("hash", b).bitwiseAND(F.lit(1))).alias(f"b{b}") for b in range(64)]
    out = hashes.groupBy(key, *series_of(hashes)).agg(
        F.count("hash").alias("n"),
        F.countDistinct("episode_id").alias("n_episodes"),
        F.min("start_time").alias("start_time"),
        F.max("end_time").alias("end_time"),
        F.array_sort(F.collect_set("episode_id")).alias("episodes"),
        F.array(*ones).alias("ones"),
    )
    out = out.filter((F.col("n") >= threshold) & (F.col("n_episodes") >= threshold) & (F.col("end_time") - F.col("start_time") >= min_duration))
    apart = F.aggregate("ones", F.lit(0.0), lambda s, c: s + c * (n - c))
    return out.withColumn("confidence", F.when(n > 1, 1 - apart / (32 * n * (n - 1))).otherwise(F.lit(0.0))).drop("ones")


def _named(groups: DataFrame, episodes: DataFrame) -> DataFrame:
    """Episode ids of groups as sorted names (JN-20)."""
    # One pass over the numbered groups: a second one might number them otherwise.
    each = groups.withColumn("gid", F.monotonically_increasing_id()).withColumn("ep", F.explode("episodes"))
    named = each.join(_names(episodes).select("ep", "name"), "ep", "left").withColumn("name", F.coalesce("name", F.lit("unknown")))
    return named.groupBy("gid").agg(*[F.first(c).alias(c) for c in groups.columns], F.array_sort(F.collect_set("name")).alias("names")).drop("gid")


def _spans(groups: DataFrame, cfg: DetectConfig) -> DataFrame:
    """FLT-1 over whole clusters, whose confidence is 1."""
    return groups.filter((F.size("episodes") >= cfg.threshold) & (F.col("end_time") - F.col("start_time") >= cfg.min_duration)).withColumn("one", F.lit(1.0))


def full_duplicates(frames: DataFrame, episodes: DataFrame, cfg: DetectConfig) -> DataFrame:
    """DET-V0, SRT-3: clusters of sequences of equal length that are the same nearly throughout."""
    return _full_duplicates(in_series(frames, episodes), episodes, cfg)


def _full_duplicates(frames: DataFrame, episodes: DataFrame, cfg: DetectConfig) -> DataFrame:
    """:func:`full_duplicates` of frames that have their series."""
    own = Window.partitionBy("episode_id")
    frames = frames.withColumns({"start_time": F.min("ts").over(own), "end_time": F.max("ts").over(own)})
    # Written, since it is read again and again; it has rows of each sequence.
    sampled = materialize(windows.identity_sample(frames).drop("ts"), "sampled", tidy=True)
    found = components(joins.duplicate_links(sampled.drop("start_time", "end_time")))
    spans = sampled.groupBy("series", "episode_id").agg(F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"))
    rows = found.join(spans, found.node == spans.episode_id)
    groups = rows.groupBy("series", "component").agg(F.min_by("start_time", "node").alias("start_time"), F.min_by("end_time", "node").alias("end_time"), F.collect_set("node").alias("episodes"))
    return _rows(_named(_spans(groups, cfg), episodes), "video", "start_time", "end_time", "names", "one").orderBy("series", "start_time", F.size("episode_list"))


def opening(frames: DataFrame, episodes: DataFrame, cfg: DetectConfig) -> DataFrame:
    """DET-V1: sequences that open like the first one."""
    found = joins.opening_matches(in_series(frames, episodes), cfg.max_distance)
    groups = found.groupBy("series").agg(F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"), F.collect_set("episode_id").alias("episodes"))
    return _rows(_named(_spans(groups, cfg), episodes), "video", "start_time", "end_time", "names", "one")


def _finish(segments: DataFrame, *steps: Callable[[list[Segment]], list[Segment]]) -> DataFrame:
    """Folds one after the other over each series."""

    def run(found: list[Segment]) -> list[Segment]:
        for step in steps:
            found = step(found)
        return found

    return folds.fold_segments(segments, run)


def _least_frames(frames: DataFrame) -> int:
    return frames.groupBy("episode_id").count().agg(F.min("count")).first()[0] or 0


def similar_windows(frames: DataFrame, episodes: DataFrame, cfg: DetectConfig) -> DataFrame:
    """DET-V2's groups of equal or similar windows (AGG-1, AGG-2), merged."""
    return _similar_windows(in_series(frames, episodes), episodes, cfg)


def _similar_windows(frames: DataFrame, episodes: DataFrame, cfg: DetectConfig) -> DataFrame:
    """:func:`similar_windows` of frames that have their series."""
    width = cfg.window_frames or window_size(_least_frames(frames), cfg.min_duration)
    hashes = windows.with_opening_window(frames, width)
    if cfg.max_distance:
        numbered = hashes.withColumn("id", F.xxhash64("episode_id", "frame_idx", "start_time"))
        leaders = joins.leader_clusters(numbered.select("id", "hash", "series"), cfg.max_distance).select("id", "leader")
        groups = hash_groups(numbered.join(leaders, "id"), cfg.threshold, "leader", cfg.min_duration)
    else:
        groups = hash_groups(hashes, cfg.threshold, "hash", cfg.min_duration)
    return _finish(_rows(_named(groups, episodes), "video", "start_time", "end_time", "names", "confidence"), folds.deduplicate, folds.merge_segments)


def current(frames: DataFrame, episodes: DataFrame, cfg: DetectConfig) -> DataFrame:
    """DET-V2: full duplicates, else groups of similar windows, else time-shifted regions."""
    own = in_series(frames, episodes)
    by_time = lambda rest: time_shifted(rest, episodes, cfg)
    by_window = lambda rest: _or_else(_similar_windows(rest, episodes, cfg), rest, by_time)
    return _ordered(_or_else(_full_duplicates(own, episodes, cfg), own, by_window))


def shift_matches(h1: np.ndarray, t1: np.ndarray, h2: np.ndarray, t2: np.ndarray, min_duration: float) -> list[tuple[int, int, float]]:
    """JN-10 for one pair: (start in 1, start in 2, mean bits) of accepted chunks.

    Anchors of the first sequence are strided; the second is scanned coarsely, then around the
    best hit. The comparison adds a time penalty to the new candidate and none to the best one
    so far, so the scan is an ordered fold, not a minimum.
    """
    n1, n2 = len(h1), len(h2)
    long = max(t1[-1] if n1 else 0, t2[-1] if n2 else 0) > 600
    chunk = int(max(5 * min_duration, 300 if long else 50))
    longest = max(n1, n2)
    step = max(longest // 300, 20) if longest > 8000 else 5 if n1 > 1000 else 25
    last = max(0, n2 - chunk)
    stride = max(last // 800, 4) if last > 2000 else 3 if last > 600 else 1
    limit = 6.5 if chunk >= 300 else 6.0 if chunk >= 250 else 6.5 if chunk >= 150 else 3.0
    out = []
    if not last:
        return out
    others = np.lib.stride_tricks.sliding_window_view(h2, chunk)
    for a in range(0, max(0, n1 - chunk), step):
        anchor = h1[a : a + chunk]
        best, at = None, 0

        def scan(places: np.ndarray, anchor: np.ndarray = anchor, a: int = a) -> None:
            nonlocal best, at
            bits = np.bitwise_count(others[places] ^ anchor).sum(axis=1, dtype=np.int64)
            offset = np.abs(t2[places] - t1[a])
            penalty = np.where(offset < 5.0, 0, offset.astype(np.int64) // 2)
            for place, d, p in zip(places.tolist(), bits.tolist(), penalty.tolist(), strict=True):
                if best is None or d + p < best:
                    best, at = d, place

        scan(np.arange(0, last, stride))
        if stride > 1:
            scan(np.arange(max(0, at - 3 * stride), min(at + 3 * stride, last)))
        if best is not None and best / chunk < limit:
            out.append((a, at, best / chunk))
    return [(a, b, bits, chunk) for a, b, bits in out]


def region_groups(regions: DataFrame, threshold: int, strict: bool = True, finish: Callable[[list[Segment]], list[Segment]] | None = None) -> DataFrame:
    """JN-14: ``segments`` rows from regions (series, episode_id, name, start_time, end_time, confidence) of each series, by start; then ``finish``."""

    def group(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        name = dict(zip(rows["episode_id"], rows["name"], strict=True))
        out = []
        for g in folds.overlap_groups(list(zip(rows["episode_id"], rows["start_time"], rows["end_time"], rows["confidence"], strict=True)), threshold, strict):
            timings = [(name[e], s, t) for e, s, t, _ in g]
            value = float(np.mean([c for *_, c in g]))
            shifted = any(abs(t[1] - timings[0][1]) > 2.0 for t in timings)
            out.append(Segment(min(t[1] for t in timings), max(t[2] for t in timings), [t[0] for t in timings], value, timings if shifted else None, value))
        out.sort(key=lambda s: (s.start, s.end))
        frame = folds.from_segments(finish(out) if finish else out)
        frame.insert(0, "series", key[0])
        return frame

    return regions.groupBy("series").applyInPandas(group, SEGMENTS)


def time_shifted(frames: DataFrame, episodes: DataFrame, cfg: DetectConfig) -> DataFrame:
    """DET-V5: JN-10 per pair, regions per sequence (INT-1, FLT-6), JN-14's groups, INT-9."""
    packed = in_series(frames, episodes).groupBy("episode_id", "series").agg(F.array_sort(F.collect_list(F.struct("frame_idx", "ts", "hash"))).alias("f"))
    a, b = (packed.select(F.col("episode_id").alias(f"ep{i}"), F.col("f").alias(f"f{i}"), "series") for i in (1, 2))
    pairs = joins.dealt_pairs(a, b, F.col("ep1") < F.col("ep2"), SEQUENCES)
    min_duration = cfg.min_duration

    def match(batches):
        for batch in batches:
            rows = []
            for e1, f1, e2, f2 in zip(batch["ep1"], batch["f1"], batch["ep2"], batch["f2"], strict=True):
                h1, h2 = (np.array([x["hash"] for x in f], np.int64).view(np.uint64) for f in (f1, f2))
                t1, t2 = (np.array([x["ts"] for x in f], float) for f in (f1, f2))
                for i, j, bits, n in shift_matches(h1, t1, h2, t2, min_duration):
                    rows.append((e1, t1[i], t1[i + n - 1], 1 - bits / 64))
                    rows.append((e2, t2[j], t2[j + n - 1], 1 - bits / 64))
            yield pd.DataFrame(rows, columns=["episode_id", "start_time", "end_time", "confidence"])

    regions = pairs.mapInPandas(match, "episode_id long, start_time double, end_time double, confidence double")
    merged = intervals.trim_openings_and_endings(intervals.merge_islands(regions, 5.0))
    named = merged.join(_names(episodes), F.col("episode_id") == F.col("ep"), "left")
    named = named.select(F.coalesce("series", F.lit(0).cast("long")).alias("series"), "episode_id", F.coalesce("name", F.lit("unknown")).alias("name"), "start_time", "end_time", "confidence")
    ends = lambda out: folds.merge_segments(out[:1] + out[-1:] if len(out) > 2 else out)
    return _ordered(region_groups(named, cfg.threshold, cfg.strict, ends))


def similar_hashes(frames: DataFrame, episodes: DataFrame, cfg: DetectConfig) -> DataFrame:
    """DET-V3's groups: a window joins the first group whose first member, by sequence and place, is similar enough (AGG-3)."""
    stats = windows.lag_statistics(frames)
    threshold = stats.agg(F.avg(adaptive_threshold(cfg.similarity_threshold, F.col("complexity"), F.col("motion"), F.col("color_variance")))).first()[0]
    threshold = cfg.similarity_threshold if threshold is None else threshold
    width = cfg.window_frames or max(int(cfg.min_duration), 10)
    # An id that sorts by sequence and place; both are below 2^31.
    place = F.shiftleft(F.col("episode_id").cast("long"), 32).bitwiseOR(F.col("frame_idx").cast("long"))
    hashes = windows.rolling_hash(in_series(frames, episodes), width).withColumn("id", place)
    leaders = joins.leader_clusters(hashes.select("id", "hash", "series"), int(64 * (1 - threshold)), first_fit=True).select("id", "leader")
    groups = similarity_groups(hashes.join(leaders, "id"), cfg.threshold, "leader", cfg.min_duration)
    return _finish(_rows(_named(groups, episodes), "video", "start_time", "end_time", "names", "confidence"), folds.deduplicate, folds.merge_segments)


def _after_whole_matches(frames: DataFrame, episodes: DataFrame, cfg: DetectConfig, detector: Callable[[DataFrame, DataFrame, DetectConfig], DataFrame]) -> DataFrame:
    """Full duplicates, else openings, else what ``detector`` finds."""
    own = in_series(frames, episodes)
    by_opening = lambda rest: _or_else(opening(rest, episodes, cfg), rest, lambda left: detector(left, episodes, cfg))
    return _ordered(_or_else(_full_duplicates(own, episodes, cfg), own, by_opening))


def multi_hash(frames: DataFrame, episodes: DataFrame, cfg: DetectConfig) -> DataFrame:
    """DET-V3: duplicates, opening, else :func:`similar_hashes`.

    The detector's four hashes are one word rotated and inverted in places, which keeps
    Hamming distances, so its weighted similarity is the word's own (S-24).
    """
    return _after_whole_matches(frames, episodes, cfg, similar_hashes)


def ssim_score(a, b):
    """0.6 of signature similarity and 0.4 of keypoint agreement of two words (S-25, S-17)."""
    n1, n2 = F.bit_count(a.bitwiseAND(F.lit(255))), F.bit_count(b.bitwiseAND(F.lit(255)))
    return 0.6 * cosine(synthetic_signature(a), synthetic_signature(b)) + 0.4 * keypoint_match(n1, n2)


def similar_grids(frames: DataFrame, episodes: DataFrame, cfg: DetectConfig) -> DataFrame:
    """DET-V4's tumbling windows of pairs, scored by signature (JN-11)."""
    width = cfg.window_frames or max(int(cfg.min_duration), 10)
    own = in_series(frames, episodes)
    if cfg.strict:  # one group per window of the first sequence, with every sequence that matches it
        counted = joins.window_grid_matches(own, width, kernels.Signatures(), cfg.similarity_threshold)
        groups = counted.groupBy("series", "ep1", "w1").agg(F.min("start1").alias("start_time"), F.max("end1").alias("end_time"), F.array_union(F.array(F.first("ep1")), F.array_sort(F.collect_set("ep2"))).alias("episodes"), (F.sum("total") / F.sum("n")).alias("score"))
    else:
        pairs = joins.window_grid_join(own, width, ssim_score).filter(F.col("score") >= cfg.similarity_threshold)
        groups = pairs.select("series", F.col("start1").alias("start_time"), F.col("end1").alias("end_time"), F.array("ep1", "ep2").alias("episodes"), "score")
    groups = groups.filter((F.size("episodes") >= cfg.threshold) & (F.col("end_time") - F.col("start_time") >= cfg.min_duration))
    return _finish(_rows(_named(groups, episodes), "video", "start_time", "end_time", "names", "score"), folds.deduplicate, folds.merge_segments)


def ssim(frames: DataFrame, episodes: DataFrame, cfg: DetectConfig) -> DataFrame:
    """DET-V4: duplicates, opening, else :func:`similar_grids`."""
    return _after_whole_matches(frames, episodes, cfg, similar_grids)


def both(frames: DataFrame, episodes: DataFrame, cfg: DetectConfig) -> DataFrame:
    """DET-V6: the multi-hash answer; compare it with :func:`ssim`'s by :func:`refrain.plans.evaluate.compare_results`."""
    return multi_hash(frames, episodes, cfg)


def head_and_tail(rows: DataFrame, seconds: float = 120.0, long: float = 600.0) -> DataFrame:
    """FLT-10, SET-4: of sequences over ten minutes the first and last two; a bag, so short ones count once."""
    span = rows.groupBy("episode_id").agg(F.max("ts").alias("last"))
    joined = rows.join(span, "episode_id")
    return joined.filter((F.col("last") <= long) | (F.col("ts") < seconds) | (F.col("ts") > F.col("last") - seconds)).drop("last")


def end_regions(rows: DataFrame, seconds: float = 120.0, long: float = 600.0) -> DataFrame:
    """FLT-10 in two passes: ``region`` 0 is a sequence's first two minutes, 1 its last; one of up to ten minutes is ``whole`` in both."""
    span = rows.groupBy("episode_id").agg(F.max("ts").alias("last"))
    joined = rows.join(span, "episode_id").withColumn("whole", F.col("last") <= long)
    first, last = F.when(F.col("whole") | (F.col("ts") < seconds), 0), F.when(F.col("whole") | (F.col("ts") > F.col("last") - seconds), 1)
    return joined.withColumn("region", F.explode(F.array_compact(F.array(first, last)))).drop("last")


def match_filter(matches: DataFrame, least: float = 0.0, most: float = 240.0, apart: float | None = None) -> DataFrame:
    """FLT-3, FLT-4: bounds on both sides' durations, and on their difference."""
    d1, d2 = F.col("end1") - F.col("start1"), F.col("end2") - F.col("start2")
    keep = d1.between(least, most) & d2.between(least, most)
    return matches.filter(keep & (F.abs(d1 - d2) < apart) if apart is not None else keep)


def segments_from_matches(matches: DataFrame, episodes: DataFrame, cfg: DetectConfig, kind: str, merge: bool = True) -> DataFrame:
    """AGG-4 to AGG-8, FLT-2, FLT-5, and INT-5 if ``merge``, over the matches of each series."""
    rows = matches.select("ep1", "ep2", "start1", "end1", "start2", "end2", "match_count", "score")
    names = _names(episodes)
    for side in ("1", "2"):
        rows = rows.join(names.select(F.col("ep").alias(f"ep{side}"), F.col("name").alias(f"name{side}"), *(["series"] if side == "1" else [])), f"ep{side}", "left")
    rows = rows.withColumn("series", F.coalesce("series", F.lit(0).cast("long")))
    threshold, min_duration = cfg.threshold, cfg.min_duration

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        name = {int(e): n for side in ("1", "2") for e, n in zip(group[f"ep{side}"], group[f"name{side}"], strict=True) if n is not None}
        found = [Match(int(r.ep1), int(r.ep2), r.start1, r.end1, r.start2, r.end2, int(r.match_count), float(r.score)) for r in group.itertuples()]
        if kind == "correlation":
            made = [folds.correlation_segment(g, name, threshold) for g in folds.group_by_start(found)]
            out = [s for s in made if s is not None and s.duration >= min_duration]
        else:
            made = [folds.group_to_segment(g, name, threshold, min_duration, folds.GROUP_CONFIDENCE[kind]) for g in folds.group_matches(found)]
            out = [s for s in made if s is not None and s.duration <= 240.0]
            out = folds.merge_audio(out) if merge else out
        frame = folds.from_segments(out)
        frame.insert(0, "series", key[0])
        return frame

    return rows.groupBy("series").applyInPandas(run, SEGMENTS)


def chromaprint(landmarks: DataFrame, episodes: DataFrame, cfg: DetectConfig) -> DataFrame:
    """DET-A1 on (episode_id, ts, hash) landmarks."""
    regions = joins.landmark_regions(joins.landmark_matches(head_and_tail(in_series(landmarks, episodes))))
    return segments_from_matches(match_filter(regions, 5.0, 240.0, 30.0), episodes, cfg, "chromaprint")


def _as_matches(nearest: DataFrame) -> DataFrame:
    return nearest.select(F.col("ep1").cast("long").alias("ep1"), F.col("ep2").cast("long").alias("ep2"), "start1", "end1", "start2", "end2", F.lit(1).alias("match_count"), F.col("score").cast("double").alias("score"))


def mfcc(features: DataFrame, episodes: DataFrame, cfg: DetectConfig, width: int = 60, stride: int = 15) -> DataFrame:
    """DET-A2 on (episode_id, frame_idx, ts, coefficients, deltas, delta_deltas). Beginnings and endings are compared apart."""
    rows = end_regions(in_series(features, episodes).withColumn("value", F.struct("coefficients", "deltas", "delta_deltas")))
    found = joins.nearest_windows(windows.vector_windows(rows, "value", width, stride), kernels.MfccDistance(), False, lambda s: s < 0.35)
    return segments_from_matches(match_filter(_as_matches(found)), episodes, cfg, "mfcc")


def energy_bands(features: DataFrame, episodes: DataFrame, cfg: DetectConfig, width: int = 60, stride: int = 5) -> DataFrame:
    """DET-A4 on (episode_id, frame_idx, ts, bands, rms_energy)."""
    rows = in_series(features, episodes).withColumn("value", F.struct("bands", "rms_energy"))
    found = joins.nearest_windows(windows.vector_windows(rows, "value", width, stride), kernels.EnergyCorrelation(), True, lambda s: s >= 0.65)
    return segments_from_matches(match_filter(_as_matches(found)), episodes, cfg, "energy_bands")


def spectral_v2(frames: DataFrame, episodes: DataFrame, cfg: DetectConfig, width: int = 60) -> DataFrame:
    """DET-A3 on (episode_id, frame_idx, ts, hash) spectral hashes: nearest rolling hash (JN-8)."""
    rolled = windows.rolling_hash(in_series(frames, episodes), width).select("episode_id", F.col("frame_idx").alias("pos"), "start_time", "end_time", F.col("hash").alias("values"), "series")
    found = joins.nearest_windows(rolled, kernels.Words(), True, lambda s: s >= 0.70)
    return segments_from_matches(match_filter(_as_matches(found)), episodes, cfg, "spectral_v2")


def spectral_hash(frames: DataFrame, episodes: DataFrame, cfg: DetectConfig) -> DataFrame:
    """DET-A5: exact groups of rolling hashes."""
    width = cfg.window_frames or window_size(0, cfg.min_duration, "audio")
    groups = hash_groups(windows.rolling_hash(in_series(frames, episodes), width), cfg.threshold, "hash", cfg.min_duration)
    return _ordered(_finish(_rows(_named(groups, episodes), "audio", "start_time", "end_time", "names", "confidence"), folds.deduplicate, folds.merge_segments))


def correlation_matches(h1: list[int], h2: list[int], chunk: int, least: float = 0.5) -> list[tuple[int, int, float]]:
    """JN-9 for one pair: a cursor over the first sequence that jumps a chunk after a match and half of one otherwise."""
    a, b = np.asarray(h1), np.asarray(h2)
    out, at = [], 0
    starts = np.arange(0, max(0, len(b) - chunk + 1), max(1, chunk // 4))
    while at + chunk <= len(a) and len(starts):
        shares = (np.lib.stride_tricks.sliding_window_view(b, chunk)[starts] == a[at : at + chunk]).mean(axis=1)
        k = int(shares.argmax())
        if shares[k] > least:
            out.append((at, int(starts[k]), float(shares[k])))
            at += chunk
        else:
            at += max(1, chunk // 2)
    return out


def cross_correlation(frames: DataFrame, episodes: DataFrame, cfg: DetectConfig) -> DataFrame:
    """DET-A6: JN-9 per pair, AGG-5, AGG-7."""
    chunk = cfg.window_frames or max(int(cfg.min_duration), 10)
    packed = in_series(frames, episodes).groupBy("episode_id", "series").agg(F.array_sort(F.collect_list(F.struct("frame_idx", "ts", "hash"))).alias("f"))
    one, two = (packed.select(F.col("episode_id").alias(f"ep{i}"), F.col("f").alias(f"f{i}"), "series") for i in (1, 2))
    pairs = joins.dealt_pairs(one, two, F.col("ep1") < F.col("ep2"), SEQUENCES)

    def match(batches):
        for batch in batches:
            rows = []
            for e1, f1, e2, f2 in zip(batch["ep1"], batch["f1"], batch["ep2"], batch["f2"], strict=True):
                for i, j, share in correlation_matches([x["hash"] for x in f1], [x["hash"] for x in f2], chunk):
                    rows.append((e1, e2, f1[i]["ts"], f1[i + chunk - 1]["ts"], f2[j]["ts"], f2[j + chunk - 1]["ts"], 1, share))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in joins.PAIR_SCHEMA.split(", ")])

    return segments_from_matches(pairs.mapInPandas(match, joins.PAIR_SCHEMA), episodes, cfg, "correlation")


VIDEO_DETECTORS: dict[str, Callable[[DataFrame, DataFrame, DetectConfig], DataFrame]] = {"current": current, "multihash": multi_hash, "ssim": ssim, "both": both}
#: DET-A7 is DET-A5 under its older name.
AUDIO_DETECTORS: dict[str, Callable[..., DataFrame]] = {
    "chromaprint": chromaprint,
    "mfcc": mfcc,
    "spectral_v2": spectral_v2,
    "energy_bands": energy_bands,
    "spectral_hash": spectral_hash,
    "cross_correlation": cross_correlation,
    "fingerprint": spectral_hash,
}


def fuse(video: DataFrame | None, audio: DataFrame | None) -> DataFrame:
    """DET-X1: one modality merged, or both fused (JN-15) and merged."""
    if video is None or audio is None:
        return folds.fold_segments(video if audio is None else audio, folds.merge_segments)
    both_ = video.withColumn("side", F.lit(0)).unionByName(audio.withColumn("side", F.lit(1)))

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        sides = [sorted((folds.to_segment(r) for r in group[group["side"] == i].to_dict("records")), key=lambda s: (s.start, s.end, s.episodes, s.confidence)) for i in (0, 1)]
        frame = folds.from_segments(folds.merge_segments(folds.fuse(*sides)))
        frame.insert(0, "series", key[0])
        return frame

    return both_.groupBy("series").applyInPandas(run, SEGMENTS)

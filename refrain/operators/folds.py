"""Ordered folds: plain cores over small lists, and their grouped forms.

Each fold has a total order, so its result doesn't depend on how rows arrive. Grouped forms
run once per series (the ``key`` column), which is the unit that fits into a task: the
matches or segments that one series' detection leaves, not its frames.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from operator import attrgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

Timing = tuple[str, float, float]
SEGMENT_SCHEMA = "start_time double, end_time double, episode_list array<string>, episode_timings array<struct<episode_name:string,start_time:double,end_time:double>>, confidence double, video_confidence double, audio_confidence double, match_type string"


@dataclass(slots=True)
class Segment:
    """A common segment (the ``segments`` row)."""

    start: float
    end: float
    episodes: list[str]
    confidence: float = 0.0
    timings: list[Timing] | None = None
    video: float | None = None
    audio: float | None = None
    kind: str = "video"

    @property
    def duration(self) -> float:
        return self.end - self.start


@dataclass
class Match:
    """A pair match (the ``pair_matches`` row)."""

    ep1: int
    ep2: int
    start1: float
    end1: float
    start2: float
    end2: float
    count: int = 0
    score: float = 0.0
    tags: dict = field(default_factory=dict)


KIND_RANK = {"audio": 0, "video": 1, "audio+video": 2}


def union_list(a: list[str], b: list[str]) -> list[str]:
    """SET-1: ``a``, then what ``b`` has besides."""
    return list(dict.fromkeys([*a, *b]))


def first_fit(items: list, close: Callable[[object, object], bool]) -> list[list]:
    """Each item joins the first group whose first member is close, or opens one."""
    groups: list[list] = []
    for item in items:
        home = next((g for g in groups if close(g[0], item)), None)
        if home is None:
            groups.append([item])
        else:
            home.append(item)
    return groups


def group_matches(matches: list[Match], within: float = 30.0) -> list[list[Match]]:
    """AGG-4: by both ends of the first side."""
    order = sorted(matches, key=lambda m: (m.ep1, m.ep2, m.start1, m.end1, m.start2, m.end2))
    return first_fit(order, lambda a, b: abs(a.start1 - b.start1) < within and abs(a.end1 - b.end1) < within)


def group_by_start(matches: list[Match], within: float = 5.0) -> list[list[Match]]:
    """AGG-5: by the start of the first side."""
    order = sorted(matches, key=lambda m: (m.ep1, m.ep2, m.start1, m.end1, m.start2, m.end2))
    return first_fit(order, lambda a, b: abs(a.start1 - b.start1) < within)


def merge_ranges(ranges: list[tuple[float, float]], gap: float) -> list[tuple[float, float]]:
    out: list[tuple[float, float]] = []
    for s, e in sorted(ranges):
        if out and s - out[-1][1] <= gap:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def group_to_segment(group: list[Match], names: dict[int, str], threshold: int, min_duration: float, confidence: Callable[[list[Match]], float], kind: str = "audio") -> Segment | None:
    """AGG-6, FLT-2: both sides of a group by sequence; ranges two seconds apart merge, the largest (the last of equals, to the millisecond) counts."""
    ranges: dict[int, list[tuple[float, float]]] = {}
    for m in group:
        ranges.setdefault(m.ep1, []).append((m.start1, m.end1))
        ranges.setdefault(m.ep2, []).append((m.start2, m.end2))
    if len(ranges) < threshold:
        return None
    timings: list[Timing] = []
    for ep in sorted(ranges):
        s, e = max(merge_ranges(ranges[ep], 2.0), key=lambda r: (int((r[1] - r[0]) * 1000), r[0]))
        if e - s >= min_duration:
            timings.append((names.get(ep, "unknown"), s, e))
    if len(timings) < threshold:
        return None
    value = confidence(group)
    shifted = any(abs(t[1] - timings[0][1]) > 2.0 for t in timings)
    return Segment(min(t[1] for t in timings), max(t[2] for t in timings), [t[0] for t in timings], value, timings if shifted else None, None, value, kind)


#: AGG-8: confidence of a group, by detector.
GROUP_CONFIDENCE: dict[str, Callable[[list[Match]], float]] = {
    "chromaprint": lambda g: min(float(np.mean([m.count for m in g])) / 50, 1.0) * 0.8 + 0.2,
    "mfcc": lambda g: 1 - min(float(np.mean([m.score for m in g])), 1.0),
    "energy_bands": lambda g: float(np.mean([m.score for m in g])),
    "spectral_v2": lambda g: float(np.mean([m.score for m in g])),
}


def correlation_segment(group: list[Match], names: dict[int, str], threshold: int) -> Segment | None:
    """AGG-7."""
    eps = sorted({m.ep1 for m in group} | {m.ep2 for m in group})
    if len(eps) < threshold:
        return None
    start = float(np.mean([min(m.start1, m.start2) for m in group]))
    end = float(np.mean([max(m.end1, m.end2) for m in group]))
    value = float(np.mean([m.score for m in group]))
    return Segment(start, end, [names.get(e, "unknown") for e in eps], value, None, None, value, "audio")


def merge_segments(segments: list[Segment]) -> list[Segment]:
    """INT-2: overlapping or nearly touching segments become one; timings of one sequence widen only where they meet within five seconds."""
    out: list[Segment] = []
    names: dict[str, None] | None = None  # of the last segment, while it grows
    for new in sorted(segments, key=lambda s: (s.start, s.end, s.episodes)):
        now = out[-1] if out else None
        allowed = 0.5 if now and now.timings is not None and new.timings is not None else 2.0
        if now is None or not (now.end > new.start or new.start - now.end <= allowed):
            if names is not None:
                now.episodes, names = list(names), None
            out.append(replace(new, episodes=list(new.episodes), timings=list(new.timings) if new.timings is not None else None))
            continue
        now.end = max(now.end, new.end)
        now.confidence = max(now.confidence, new.confidence)
        for side in ("video", "audio"):
            values = [v for v in (getattr(now, side), getattr(new, side)) if v is not None]
            setattr(now, side, max(values) if values else None)
        now.kind = max((now.kind, new.kind), key=KIND_RANK.__getitem__)
        if now.timings is None and new.timings is None:
            names = dict.fromkeys(now.episodes) if names is None else names
            names.update(dict.fromkeys(new.episodes))
            continue
        names = None  # timings have the names from here on
        held = {name: (s, e) for name, s, e in now.timings or []}
        for name, s, e in new.timings or []:
            a, b = held.get(name, (s, e))
            held[name] = (min(a, s), max(b, e)) if s <= b + 5 and e >= a - 5 else (a, b)
        now.timings = [(name, s, e) for name, (s, e) in held.items()]
        now.episodes = [t[0] for t in now.timings]
    if names is not None:
        out[-1].episodes = list(names)
    return out


def merge_segments_running(segments: list[Segment]) -> list[Segment]:
    """INT-3: five-second merge with a pairwise running mean of confidences and sorted names."""
    out: list[Segment] = []
    for new in sorted(segments, key=lambda s: (s.start, s.end, s.episodes)):
        if out and new.start - out[-1].end <= 5.0:
            now = out[-1]
            now.end, now.confidence = max(now.end, new.end), (now.confidence + new.confidence) / 2
            now.episodes = sorted({*now.episodes, *new.episodes})
        else:
            out.append(replace(new, episodes=list(new.episodes)))
    return out


def iou(a: Segment, b: Segment) -> float:
    common, union = min(a.end, b.end) - max(a.start, b.start), max(a.end, b.end) - min(a.start, b.start)
    return common / union if common > 0 and union > 0 else 0.0


def deduplicate(segments: list[Segment]) -> list[Segment]:
    """INT-4: a segment that overlaps an earlier one by half, in time and by 0.7 in sequences, is taken into it.

    Of the earlier ones only those are tried that can be the answer: with the same sequence
    where all have a single one, else those that overlap enough; and, where segments come by
    start, not those that ended before.
    """
    by_start = all(a.start <= b.start for a, b in zip(segments, segments[1:], strict=False))
    return (_deduplicate_single if all(len(s.episodes) == 1 for s in segments) else _deduplicate_lists)(segments, by_start)


def _copy(s: Segment) -> Segment:
    """With the same list of names, which folds replace and don't change."""
    return Segment(s.start, s.end, s.episodes, s.confidence, s.timings, s.video, s.audio, s.kind)


def _deduplicate_single(segments: list[Segment], by_start: bool) -> list[Segment]:
    out: list[Segment] = []
    held: dict[str, list[Segment]] = {}
    for new in segments:
        start, end, ended = new.start, new.end, 0
        olds = held.setdefault(new.episodes[0], [])
        for old in olds:
            s, e = old.start, old.end
            common = (e if e < end else end) - (s if s > start else start)
            if common > 0:
                union = (e if e > end else end) - (s if s < start else start)
                if union > 0 and common / union > 0.5:
                    old.start, old.end, old.confidence = min(s, start), max(e, end), max(old.confidence, new.confidence)
                    break
            elif e <= start:
                ended += 1
        else:
            new = _copy(new)
            out.append(new)
            if by_start and ended > 4:
                olds[:] = [o for o in olds if o.end > start]
            olds.append(new)
    return out


def _marks(segments: list[Segment], block: int = 1024) -> np.ndarray:
    """Bits of each segment: one for every name, or for some names together where there are far more than a segment has."""
    number: dict[str, int] = {}
    for s in segments:
        for name in s.episodes:
            number.setdefault(name, len(number))
    mean = max(1, sum(len(s.episodes) for s in segments) // max(1, len(segments)))
    width = max(1, min(-(-len(number) // 64), mean // 8 + 1))
    marks = np.zeros((len(segments), width), np.uint64)
    for lo in range(0, len(segments), block):
        some = segments[lo : lo + block]
        at = np.fromiter((number[name] for s in some for name in s.episodes), np.int64) % (64 * width)
        rows = np.repeat(np.arange(len(some)), [len(s.episodes) for s in some])
        np.bitwise_or.at(marks[lo : lo + block], (rows, at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
    return marks


def _deduplicate_lists(segments: list[Segment], by_start: bool) -> list[Segment]:
    """Names are compared only where marks leave room: a mark that one side alone has is a name, at least, that isn't shared."""
    out: list[Segment] = []
    marks = _marks(segments)
    # Of segments that can still be met: places in ``out``, starts, ends, names, marks, how many names have no mark of their own, and if none is there twice.
    place, starts, ends, sizes, spare, once, n = np.empty(1024, np.int64), np.empty(1024), np.empty(1024), np.empty(1024, np.int64), np.empty(1024, np.int64), np.empty(1024, bool), 0
    held = np.empty((1024, marks.shape[1]), np.uint64)
    sets: dict[int, set[str]] = {}  # names of ``out``, of those that were asked for
    for new, mark in zip(segments, marks, strict=True):
        many, own = len(new.episodes), int(np.bitwise_count(mark).sum())
        s, e = starts[:n], ends[:n]
        common, union = np.minimum(e, new.end) - np.maximum(s, new.start), np.maximum(e, new.end) - np.minimum(s, new.start)
        with np.errstate(all="ignore"):
            near = np.flatnonzero((common > 0) & (union > 0) & (common / union > 0.5))
        both = np.bitwise_count(held[near] & mark).sum(axis=1, dtype=np.int64)
        most = np.minimum(spare[near] + both, np.where(once[near], many - own + both, sizes[near]))
        least = np.minimum(sizes[near], many)
        for k in near[(least > 0) & (most / np.maximum(least, 1) > 0.7)].tolist():
            at = int(place[k])
            old = out[at]
            asked = set(new.episodes)
            if once[k]:
                if at not in sets:
                    sets[at] = set(old.episodes)
                shared = len(sets[at] & asked)
            else:  # a name more than once counts as often
                shared = sum(x in asked for x in old.episodes)
            if shared / min(len(old.episodes), many) > 0.7:
                old.start, old.end = min(old.start, new.start), max(old.end, new.end)
                old.episodes, old.confidence = union_list(old.episodes, new.episodes), max(old.confidence, new.confidence)
                sets[at], once[k], held[k] = set(old.episodes), True, held[k] | mark
                starts[k], ends[k], sizes[k] = old.start, old.end, len(old.episodes)
                spare[k] = sizes[k] - int(np.bitwise_count(held[k]).sum())
                break
        else:
            if n == len(place):
                kept = np.flatnonzero(~(ends[:n] <= new.start)) if by_start else np.arange(n)
                if by_start:
                    alive = set(place[kept].tolist())
                    sets = {at: x for at, x in sets.items() if at in alive}
                grown = 2 * n if len(kept) > n // 2 else n
                place, starts, ends, sizes, spare, once, held = (np.concatenate([x[kept], np.empty((grown - len(kept), *x.shape[1:]), x.dtype)]) for x in (place, starts, ends, sizes, spare, once, held))
                n = len(kept)
            place[n], starts[n], ends[n], sizes[n], spare[n], once[n], held[n] = len(out), new.start, new.end, many, many - own, len(set(new.episodes)) == many, mark
            n += 1
            out.append(_copy(new))
    return out


def merge_audio(segments: list[Segment]) -> list[Segment]:
    """INT-5: merged where half of the shorter one overlaps, or short ones nearly touch."""
    out: list[Segment] = []
    for new in sorted(segments, key=lambda s: (s.start, s.end, s.episodes)):
        now = out[-1] if out else None
        joins = False
        if now is not None:
            common = min(now.end, new.end) - max(now.start, new.start)
            gap = new.start - now.end
            joins = (common > 0 and common >= 0.5 * min(now.duration, new.duration)) or (0 <= gap < 2 and now.duration < 60 and new.duration < 60)
        if not joins:
            out.append(replace(new, episodes=list(new.episodes), timings=list(new.timings) if new.timings is not None else None))
            continue
        now.end, now.confidence = max(now.end, new.end), max(now.confidence, new.confidence)
        values = [v for v in (now.audio, new.audio) if v is not None]
        now.audio = max(values) if values else None
        now.episodes = union_list(now.episodes, new.episodes)
        if now.timings is None:
            now.timings = new.timings
        elif new.timings is not None:
            held = {n: (s, e) for n, s, e in now.timings}
            for n, s, e in new.timings:
                a, b = held.get(n, (s, e))
                held[n] = (min(a, s), max(b, e))
            now.timings = [(n, s, e) for n, (s, e) in held.items()]
    return out


def drop_near_repeats(segments: list[Segment], within: float = 0.1) -> list[Segment]:
    """INT-10: drops a segment whose ends are both within ``within`` of the last one kept."""
    out: list[Segment] = []
    for s in segments:
        if not (out and abs(out[-1].start - s.start) < within and abs(out[-1].end - s.end) < within):
            out.append(s)
    return out


def overlap_groups(regions: list[tuple[int, float, float, float]], threshold: int, strict: bool = True) -> list[list[tuple[int, float, float, float]]]:
    """JN-14: regions (sequence, start, end, confidence) around a leader region of another sequence; each is used once.

    ``strict`` counts distinct sequences against the threshold, else regions.
    """
    order = sorted(regions)
    used = [False] * len(order)
    out = []
    for i, (ep, s, e, _) in enumerate(order):
        if used[i]:
            continue
        used[i] = True
        group = [order[i]]
        for j, (ep2, s2, e2, _) in enumerate(order):
            if not used[j] and ep2 != ep and (max(s, s2) < min(e, e2) or abs(s2 - e) < 5.0 or abs(s - e2) < 5.0):
                used[j] = True
                group.append(order[j])
        if (len({g[0] for g in group}) if strict else len(group)) >= threshold:
            out.append(group)
    return out


def fuse(video: list[Segment], audio: list[Segment]) -> list[Segment]:
    """JN-15: each video segment takes the first unused audio segment that overlaps half of the shorter one (or all but touches); the rest is appended."""
    used: set[int] = set()
    out: list[Segment] = []
    for v in video:
        for i, a in enumerate(audio):
            common = min(v.end, a.end) - max(v.start, a.start)
            if i not in used and (common > 0.5 * min(v.duration, a.duration) or abs(common) < 1.0):
                used.add(i)
                out.append(replace(v, episodes=union_list(v.episodes, a.episodes), confidence=(v.confidence + a.confidence) / 2, video=v.confidence, audio=a.confidence, kind="audio+video"))
                break
        else:
            out.append(v)
    out += [a for i, a in enumerate(audio) if i not in used]
    return sorted(out, key=lambda s: (s.start, s.end))


def match_expected(detected: list[Segment], expected: list[tuple[float, float, int]]) -> list[int | None]:
    """JN-16: for each detection, in order, the first unused expectation that it covers by half, with enough sequences."""
    used: set[int] = set()
    out: list[int | None] = []
    for d in detected:
        hit = None
        for i, (s, e, least) in enumerate(expected):
            common = min(d.end, e) - max(d.start, s)
            if i not in used and common > 0.5 * min(d.duration, e - s) and len(d.episodes) >= least:
                hit = i
                used.add(i)
                break
        out.append(hit)
    return out


def to_segment(row) -> Segment:
    timings = row["episode_timings"]
    pick = lambda t, k, i: t[k] if isinstance(t, dict) else t[i]
    known = None if timings is None else [(pick(t, "episode_name", 0), pick(t, "start_time", 1), pick(t, "end_time", 2)) for t in timings]
    value = lambda x: None if x is None or x != x else float(x)
    return Segment(float(row["start_time"]), float(row["end_time"]), list(row["episode_list"]), float(row["confidence"]), known, value(row["video_confidence"]), value(row["audio_confidence"]), row["match_type"])


def from_segments(segments: list[Segment]) -> pd.DataFrame:
    rows = []
    for s in segments:
        timings = None if s.timings is None else [{"episode_name": n, "start_time": float(a), "end_time": float(b)} for n, a, b in s.timings]
        rows.append((float(s.start), float(s.end), s.episodes, timings, float(s.confidence), s.video, s.audio, s.kind))
    frame = pd.DataFrame(rows, columns=["start_time", "end_time", "episode_list", "episode_timings", "confidence", "video_confidence", "audio_confidence", "match_type"])
    return frame.astype({"video_confidence": "float64", "audio_confidence": "float64"})


TIMINGS = pa.list_(pa.struct([("episode_name", pa.string()), ("start_time", pa.float64()), ("end_time", pa.float64())]))


def _name_lists(column: pa.ChunkedArray) -> list[list[str]]:
    """Lists of names, in which a name is one object however often it comes: segments may have many more names than there are sequences."""
    out: list[list[str]] = []
    known: dict[str, str] = {}
    for chunk in column.chunks:
        names = chunk.flatten()
        if chunk.null_count or names.null_count:
            out += chunk.to_pylist()
            continue
        coded = names.dictionary_encode()
        each = np.array([known.setdefault(x, x) for x in coded.dictionary.to_pylist()], object)[coded.indices.to_numpy()]
        ends = np.cumsum(chunk.value_lengths().to_numpy()).tolist()
        out += [each[a:b].tolist() for a, b in zip([0, *ends], ends, strict=False)]
    return out


def read_segments(table: pa.Table) -> list[Segment]:
    """The rows of a ``segments`` table; an unknown number is NaN, an unknown side None."""
    number = lambda c: [float("nan") if x is None else float(x) for x in table.column(c).to_pylist()]
    side = lambda c: [None if x is None or x != x else float(x) for x in table.column(c).to_pylist()]
    optional = lambda c, read: [None] * table.num_rows if table.column(c).null_count == table.num_rows else read(c)
    timings = lambda c: [x and [(t["episode_name"], t["start_time"], t["end_time"]) for t in x] for x in table.column(c).to_pylist()]
    columns = number("start_time"), number("end_time"), _name_lists(table.column("episode_list")), number("confidence"), optional("episode_timings", timings), optional("video_confidence", side), optional("audio_confidence", side), table.column("match_type").to_pylist()
    return list(map(Segment, *columns))


def write_segments(segments: list[Segment]) -> dict[str, pa.Array]:
    """Columns of a ``segments`` table; NaN becomes null."""
    of = lambda name: [getattr(s, name) for s in segments]
    number = lambda name: pa.array(of(name), pa.float64(), from_pandas=True)
    timings = [s.timings and [{"episode_name": n, "start_time": a, "end_time": b} for n, a, b in s.timings] for s in segments]
    return {
        "start_time": number("start"),
        "end_time": number("end"),
        "episode_list": pa.array(of("episodes"), pa.list_(pa.string())),
        "episode_timings": pa.array(timings, TIMINGS),
        "confidence": number("confidence"),
        "video_confidence": number("video"),
        "audio_confidence": number("audio"),
        "match_type": pa.array(of("kind"), pa.string()),
    }


def fold_segments(segments: DataFrame, fold: Callable[[list[Segment]], list[Segment]], key: str = "series") -> DataFrame:
    """A fold over the segments of each series, in (start, end, names, confidence) order."""
    order = attrgetter("start", "end", "episodes", "confidence")

    def run(k: tuple, group: pa.Table) -> pa.Table:
        out = fold(sorted(read_segments(group), key=order))
        return pa.table({key: pa.array([k[0].as_py()] * len(out), group.schema.field(key).type), **write_segments(out)})

    return segments.groupBy(key).applyInArrow(run, f"{key} {segments.schema[key].dataType.simpleString()}, {SEGMENT_SCHEMA}")

import itertools
import random

import numpy as np
import pytest

from refrain.operators import folds, intervals, joins, windows
from refrain.operators.components import components
from refrain.operators.folds import Match, Segment


def frames(spark, seqs, start=0.0):
    rows = [(e, i, start + i, h) for e, hs in seqs.items() for i, h in enumerate(hs)]
    return spark.createDataFrame(rows, "episode_id int, frame_idx int, ts double, hash long")


def test_rolling_hash(spark):
    rows = windows.rolling_hash(frames(spark, {0: [1, 2, 3, 4, 5], 1: [7, 7, 7, 7]}), 3).orderBy("episode_id", "frame_idx").collect()
    assert [r.frame_idx for r in rows] == [2, 3, 4, 2, 3]
    assert len({r.hash for r in rows[:3]}) == 3 and rows[3].hash == rows[4].hash
    assert (rows[0].start_time, rows[0].end_time) == (0.0, 2.0)


def test_complement(spark):
    durations = spark.createDataFrame([(i, 100.0) for i in range(6)], "episode_id int, duration double")
    removed = [(1, 20.0, 30.0), (2, 10.0, 20.0), (2, 30.0, 40.0), (2, 50.0, 60.0), (3, 10.0, 20.0), (3, 20.0, 30.0), (4, 0.0, 20.0), (5, 80.0, 100.0)]
    rows = spark.createDataFrame(removed, "episode_id int, start_time double, end_time double")
    got = {}
    for r in intervals.keeps_from_removals(rows, durations).orderBy("episode_id", "start_time").collect():
        got.setdefault(r.episode_id, []).append((r.start_time, r.end_time))
    assert got == {0: [(0, 100)], 1: [(0, 20), (30, 100)], 2: [(0, 10), (20, 30), (40, 50), (60, 100)], 3: [(0, 10), (30, 100)], 4: [(20, 100)], 5: [(0, 80)]}
    back = intervals.removals_from_keeps(intervals.keeps_from_removals(rows, durations), durations).filter("episode_id = 2").orderBy("start_time").collect()
    assert [(r.start_time, r.end_time) for r in back] == [(10, 20), (30, 40), (50, 60)]


def test_islands_are_idempotent(spark):
    rng = random.Random(2)
    rows = spark.createDataFrame([(rng.randrange(5), float(s := rng.randrange(100)), float(s + rng.randrange(1, 9))) for _ in range(60)], "episode_id int, start_time double, end_time double")
    once = intervals.merge_islands(rows).select("episode_id", "start_time", "end_time")
    assert sorted(once.collect()) == sorted(intervals.merge_islands(once).select("episode_id", "start_time", "end_time").collect())


@pytest.mark.parametrize("radius", [0, 3, 8, 12, 20])
def test_hamming_join_is_brute_force(spark, radius):
    rng = random.Random(radius)
    base = [rng.getrandbits(64) for _ in range(12)]
    words = [w ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(10))) for w in base for _ in range(6)]
    words = [w - (1 << 64) if w >> 63 else w for w in words]
    got = {(r.a, r.b, r.distance) for r in joins.hamming_join(spark.createDataFrame(list(enumerate(words)), "id long, hash long"), radius).collect()}
    want = {(i, j, d) for i, j in itertools.combinations(range(len(words)), 2) if (d := bin((words[i] ^ words[j]) & (1 << 64) - 1).count("1")) <= radius}
    assert got == want


@pytest.mark.parametrize("radius", [0, 4, 10])
def test_leader_clusters_follow_the_sequential_rule(spark, radius):
    rng = random.Random(radius)
    words = [rng.getrandbits(10) for _ in range(80)]
    leaders, want = [], {}
    for i, w in enumerate(words):
        near = [(bin(words[k] ^ w).count("1"), k) for k in leaders if bin(words[k] ^ w).count("1") <= radius]
        if not near:
            leaders.append(i)
        want[i] = min(near)[1] if near else i
    got = joins.leader_clusters(spark.createDataFrame(list(enumerate(words)), "id long, hash long"), radius)
    assert {r.id: r.leader for r in got.collect()} == want


def test_components(spark):
    edges = [(5, 6), (6, 7), (2, 9), (9, 1), (30, 31), (31, 5)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {5: 5, 6: 5, 7: 5, 30: 5, 31: 5, 1: 1, 2: 1, 9: 1}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_dense_regions():
    close = [(i * 1.0, i * 1.0 + 40) for i in range(12)]
    assert joins.dense_regions(close) == [(0.0, 11.0, 40.0, 51.0, 12)]
    assert joins.dense_regions([(0.0, 0.0), (10.0, 10.0)]) == []
    assert len(joins.dense_regions(close + [(t + 100, u + 100) for t, u in close])) == 2


def test_nearest_window_ties_go_to_the_earlier(spark):
    from refrain.functions.hashing import hamming_similarity

    rows = spark.createDataFrame([(0, 0, 0.0, 0.0, 5), (1, 0, 0.0, 0.0, 4), (1, 1, 1.0, 1.0, 7), (1, 2, 2.0, 2.0, 5 + 1024)], "episode_id int, pos long, start_time double, end_time double, values long")
    got = joins.nearest_windows(rows, hamming_similarity, True, lambda s: s > 0.5).collect()
    assert [(r.pos1, r.pos2) for r in got] == [(0, 0)]


def seg(s, e, c=0.8, names=("a",), **more):
    return Segment(float(s), float(e), list(names), c, **more)


def test_segment_merge():
    out = folds.merge_segments([seg(0, 10, 0.8, ["a"]), seg(8, 18, 0.9, ["b"]), seg(25, 35, 0.7, ["c"])])
    assert [(s.start, s.end, s.episodes) for s in out] == [(0, 18, ["a", "b"]), (25, 35, ["c"])]
    assert folds.merge_segments(out) == out


def test_audio_merge():
    one = folds.merge_audio([seg(0, 10, 0.8), seg(5, 15, 0.9)])
    assert [(s.start, s.end, s.confidence) for s in one] == [(0, 15, 0.9)]
    assert len(folds.merge_audio([seg(0, 10), seg(50, 60)])) == 2


def test_deduplicate_and_near_repeats():
    assert len(folds.deduplicate([seg(0, 10), seg(1, 10), seg(40, 50)])) == 2
    assert len(folds.drop_near_repeats([seg(0, 10), seg(0.05, 10.05), seg(3, 9)])) == 2
    assert [s.confidence for s in folds.merge_segments_running([seg(0, 10, 0.8), seg(14, 20, 0.4)])] == pytest.approx([0.6])


def test_fusion_appends_leftovers():
    out = folds.fuse([seg(0, 10, 0.8, ["a", "b"])], [seg(1, 11, 0.6, ["b", "c"], kind="audio"), seg(40, 50, 0.5, ["a"], kind="audio")])
    assert [(s.start, s.kind) for s in out] == [(0, "audio+video"), (40, "audio")]
    assert out[0].episodes == ["a", "b", "c"] and out[0].confidence == pytest.approx(0.7)


def test_group_to_segment_keeps_the_largest_range():
    group = [Match(0, 1, 10, 30, 12, 32, 20, 1.0), Match(0, 2, 11, 31, 50, 70, 20, 1.0)]
    made = folds.group_to_segment(group, {0: "a", 1: "b", 2: "c"}, 3, 5.0, folds.GROUP_CONFIDENCE["chromaprint"])
    assert made.episodes == ["a", "b", "c"] and made.timings[0] == ("a", 10, 31) and made.confidence == pytest.approx(0.52)
    assert folds.group_to_segment(group, {}, 4, 5.0, lambda g: 1.0) is None


def test_overlap_groups_count_sequences_when_strict():
    regions = [(0, 0.0, 10.0, 1.0), (1, 1.0, 9.0, 1.0), (1, 8.0, 12.0, 1.0)]
    assert folds.overlap_groups(regions, 3, strict=True) == [] and len(folds.overlap_groups(regions, 3, strict=False)) == 1


def test_expected_matching():
    assert folds.match_expected([seg(0, 10), seg(0, 9), seg(50, 60)], [(0, 10, 1), (0, 12, 1), (50, 60, 2)]) == [0, 1, None]


def test_opening_and_duplicates(spark):
    rng = np.random.default_rng(1)
    shared = rng.integers(0, 1 << 60, 12).tolist()
    f = frames(spark, {0: shared, 1: shared, 2: rng.integers(0, 1 << 60, 12).tolist()})
    assert [r.episode_id for r in joins.opening_matches(f, 4).orderBy("episode_id").collect()] == [0, 1]
    assert [(r.ep1, r.ep2, r.share) for r in joins.full_duplicates(f, windows.identity_sample(f)).collect()] == [(0, 1, 1.0)]


def nearest_rows(spark, value, schema, **more):
    rng = random.Random(6)
    pool = [value(rng) for _ in range(40)]
    rows = [(ep, pos, float(pos), pos + 4.0, region, ep % 3 == 0, ep % 2, rng.choice(pool) if rng.random() < 0.97 else None) for ep in range(9) for region in range(2) for pos in range(rng.randrange(3, 12))]
    return spark.createDataFrame(rows, f"episode_id int, pos long, start_time double, end_time double, region int, whole boolean, series long, values {schema}")


def frames_of(*names):
    def made(rng):
        numbers = lambda: [rng.randrange(-3, 4) / 4 for _ in range(5)]
        return [tuple(numbers() if n != "rms_energy" else float(rng.randrange(4)) for n in names) for _ in range(3)]

    return made, f"array<struct<{', '.join(n + (':double' if n == 'rms_energy' else ':array<double>') for n in names)}>>"


def mean_over(score):
    from pyspark.sql import functions as F

    return lambda a, b: F.aggregate(F.zip_with(a, b, score), F.lit(0.0), lambda s, x: s + x) / F.size(a)


@pytest.mark.parametrize("kind", ["words", "mfcc", "energy"])
def test_blocks_find_the_nearest_windows_of_all_pairs(spark, kind):
    """Copies of windows, sequences in two series and regions, windows without values, and pairs in many blocks."""
    from refrain.functions import kernels, similarity
    from refrain.functions.hashing import hamming_similarity

    score, kernel, largest, (value, schema) = {
        "words": (hamming_similarity, kernels.Words(), True, (lambda rng: rng.getrandbits(12) - 2048, "long")),
        "mfcc": (mean_over(similarity.mfcc_distance), kernels.MfccDistance(), False, frames_of("coefficients", "deltas", "delta_deltas")),
        "energy": (mean_over(similarity.energy_correlation), kernels.EnergyCorrelation(), True, frames_of("bands", "rms_energy")),
    }[kind]
    rows = nearest_rows(spark, value, schema)
    shown = lambda df: sorted((r.ep1, r.ep2, r.pos1, r.start1, r.end1, r.start2, r.end2, r.pos2, round(r.score, 9)) for r in df.collect())
    want = shown(joins.nearest_windows(rows.filter("values is not null"), score, largest, lambda s: s > -9))
    for size in (7, 10000):
        assert shown(joins.nearest_windows(rows, kernel, largest, lambda s: s > -9, size)) == want != []


def test_pairs_of_windows_are_no_rows(spark):
    """Ten sequences of 300 words: what is written between steps is in proportion to words, not to pairs."""
    from refrain.functions import kernels

    rng = random.Random(8)
    rows = spark.createDataFrame([(e, p, float(p), float(p), rng.getrandbits(62)) for e in range(10) for p in range(300)], "episode_id int, pos long, start_time double, end_time double, values long")
    assert joins._kernel_windows(rows.selectExpr("*", "0 as region", "true as whole"), kernels.Words(), 5000).count() == 45 * 300


def plain_deduplicate(segments):
    out = []
    for new in segments:
        for old in out:
            least = min(len(old.episodes), len(new.episodes))
            shared = sum(e in new.episodes for e in old.episodes) / least if least else 0.0
            if folds.iou(old, new) > 0.5 and shared > 0.7:
                old.start, old.end = min(old.start, new.start), max(old.end, new.end)
                old.episodes, old.confidence = folds.union_list(old.episodes, new.episodes), max(old.confidence, new.confidence)
                break
        else:
            out.append(seg(new.start, new.end, new.confidence, new.episodes))
    return out


@pytest.mark.parametrize(("most", "ordered"), [(1, True), (1, False), (5, True), (5, False)])
def test_deduplicate_is_the_plain_fold(most, ordered):
    rng = random.Random(most)
    for spread, n in ((20, 300), (4000, 3000)):
        found = [seg(s := rng.randrange(spread), s + rng.randrange(0, 9), rng.random(), [f"e{rng.randrange(6)}" for _ in range(rng.randrange(min(1, most - 1) and 0 if most > 1 else 1, most + 1))]) for _ in range(n)]
        if ordered:
            found.sort(key=lambda s: (s.start, s.end, s.episodes, s.confidence))
        assert folds.deduplicate(found) == plain_deduplicate(found)


@pytest.mark.parametrize("twice", [False, True])
def test_deduplicate_with_names_that_share_marks(twice):
    """Three hundred sequences, of which a segment has few: several names have the same mark, and some segments are near copies."""
    rng = random.Random(5)
    names, pool, found = [f"s{i}" for i in range(300)], [], []
    for _ in range(600):
        own = rng.sample(rng.choice(pool), 7) + rng.sample(names, 2) if pool and rng.random() < 0.4 else rng.sample(names, rng.randrange(7, 13))
        own = own + own[:4] if twice and rng.random() < 0.3 else own if twice else list(dict.fromkeys(own))
        pool.append(own)
        found.append(seg(s := rng.randrange(40) / 4, s + 2, rng.random(), own))
    assert folds._marks(found).shape[1] < 5
    for order in (found, sorted(found, key=lambda s: (s.start, s.end, s.episodes))):
        made = folds.deduplicate(order)
        assert made == plain_deduplicate(order) and len(made) < len(found)


def test_both_widths_are_made_in_one_pass(spark, tmp_path):
    path = str(tmp_path / "frames")
    frames(spark, {0: [1, 2, None, 4, 5, 6, 7], 1: [7, 7, 7, 7, 7]}).write.parquet(path)
    stored = spark.read.parquet(path)
    made = windows.with_opening_window(stored, 4)
    assert made._jdf.queryExecution().sparkPlan().toString().count("FileScan") == 1
    one_by_one = windows.rolling_hash(stored, 4).unionByName(windows.rolling_hash(stored, 3))
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, one_by_one.collect())) != []
    wide = windows.rolling_hash(frames(spark, {0: list(range(1, 31))}), windows.LAGS + 1)
    assert wide.count() == 30 - windows.LAGS and wide.agg({"start_time": "max"}).first()[0] == 30 - windows.LAGS - 1


def test_deduplicate_and_merge_are_not_quadratic():
    """A thousand sequences, of which each segment has fifty: the plain fold takes minutes for these."""
    import time

    rng = random.Random(1)
    names = [f"s{i}" for i in range(1000)]
    found = sorted((seg(s := 300 + rng.gauss(0, 50), s + 2, rng.random(), sorted(rng.sample(names, 50))) for _ in range(20000)), key=lambda s: s.start)
    began = time.process_time()
    assert len(folds.deduplicate(found)) > 19000
    folds.merge_segments(found)
    assert time.process_time() - began < 30


@pytest.mark.parametrize("block_rows", [5, 10000])
def test_counted_grids_are_all_pairs(spark, block_rows):
    from pyspark.sql import functions as F

    from refrain.functions import kernels
    from refrain.plans.detectors import ssim_score

    rng = random.Random(9)
    pool = [0, *(rng.getrandbits(64) - (1 << 63) for _ in range(20))]
    rows = spark.createDataFrame([(e, i, float(i), rng.choice(pool) if rng.random() < 0.98 else None, e % 2) for e in range(8) for i in range(rng.randrange(8, 30))], "episode_id int, frame_idx int, ts double, hash long, series long")
    pairs = joins.window_grid_join(rows, 3, ssim_score).filter("score >= 0.75")
    want = pairs.groupBy("series", "ep1", "w1", "start1", "end1", "ep2").agg(F.count("*").alias("n"), F.sum("score").alias("total"))
    made = joins.window_grid_matches(rows, 3, kernels.Signatures(), 0.75, block_rows)
    got = made.groupBy("series", "ep1", "w1", "start1", "end1", "ep2").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    shown = lambda df: sorted((r.series, r.ep1, r.w1, r.start1, r.end1, r.ep2, r.n, round(r.total, 9)) for r in df.collect())
    assert shown(got) == shown(want) != []

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from refrain.config import DetectConfig
from refrain.operators import joins, windows
from refrain.plans import detectors, evaluate
from refrain.sinks import reports
from refrain.sources import media, run_store


def planted(spark, n=3, length=90, at=(20, 26, 31), run=25, seed=1, step=1.0):
    """Random hashes; every sequence holds one shared run, at its own start."""
    rng = random.Random(seed)
    shared = [rng.getrandbits(60) for _ in range(run)]
    rows = []
    for e in range(n):
        own = [rng.getrandbits(60) for _ in range(length)]
        own[at[e] : at[e] + run] = shared
        rows += [(e, i, i * step, h) for i, h in enumerate(own)]
    frames = spark.createDataFrame(rows, "episode_id int, frame_idx int, ts double, hash long")
    names = spark.createDataFrame([(e, f"ep{e}") for e in range(n)], "episode_id int, name string")
    return frames, names


CFG = DetectConfig(threshold=3, min_duration=5.0, similarity_threshold=1.0, window_frames=6)


def test_current_finds_the_planted_run(spark):
    frames, names = planted(spark, at=(20, 20, 20))
    found = detectors.current(frames, names, CFG).collect()
    assert len(found) == 1 and found[0].start_time == 20 and found[0].end_time == 44
    assert found[0].episode_list == ["ep0", "ep1", "ep2"] and found[0].match_type == "video"


def test_current_with_a_radius(spark):
    frames, names = planted(spark, at=(20, 20, 20))
    found = detectors.current(frames, names, DetectConfig(threshold=3, min_duration=5.0, similarity_threshold=0.97, window_frames=6)).collect()
    assert any(s.start_time <= 21 and s.end_time >= 43 for s in found)


def test_identical_sequences_and_clusters(spark):
    rows = [(e, i, 10.0 + i, 100 + i) for e in range(3) for i in range(10)]
    frames = spark.createDataFrame(rows, "episode_id int, frame_idx int, ts double, hash long")
    names = spark.createDataFrame([(e, f"ep{e}") for e in range(4)], "episode_id int, name string")
    found = detectors.current(frames, names, DetectConfig(threshold=2, min_duration=5.0)).collect()
    assert len(found) >= 1 and len(found[0].episode_list) == 3
    rows = [(e, i, 10.0 + i, 100 + i + (10_000 if e > 1 else 0)) for e in range(4) for i in range(15)]
    two = detectors.current(spark.createDataFrame(rows, "episode_id int, frame_idx int, ts double, hash long"), names, DetectConfig(threshold=2, min_duration=5.0)).collect()
    assert sorted(tuple(s.episode_list) for s in two) == [("ep0", "ep1"), ("ep2", "ep3")]


@pytest.mark.parametrize("detector", ["current", "multihash", "ssim"])
def test_empty_and_single(spark, detector):
    frames, names = planted(spark)
    run = detectors.VIDEO_DETECTORS[detector]
    assert run(frames.limit(0), names, CFG).count() == 0
    assert run(frames.filter("episode_id = 0"), names, CFG).count() == 0


def test_time_shifted_run(spark):
    frames, names = planted(spark, length=260, at=(100, 110, 120), run=120)
    found = detectors.time_shifted(frames, names, DetectConfig(threshold=3, min_duration=10.0)).collect()
    assert found and len(found[0].episode_list) == 3 and found[0].confidence > 0.9


def test_multi_hash_and_ssim(spark):
    frames, names = planted(spark, at=(24, 24, 24), run=30)
    cfg = DetectConfig(threshold=3, min_duration=5.0, similarity_threshold=0.95, window_frames=6)
    assert any(len(s.episode_list) == 3 for s in detectors.multi_hash(frames, names, cfg).collect())
    assert any(len(s.episode_list) == 3 for s in detectors.ssim(frames, names, cfg).collect())


def test_multi_hash_groups_span_their_members(spark):
    rng = random.Random(6)
    rows = [(g, e, 10.0 * g + 3 * e, 10.0 * g + 3 * e + 6, rng.getrandbits(64) - (1 << 63)) for g in range(3) for e in range(4)] + [(9, 0, 1.0, 8.0, -1)]
    hashes = spark.createDataFrame(rows, "leader int, episode_id int, start_time double, end_time double, hash long")
    got = {r.leader: r for r in detectors.similarity_groups(hashes, 1, "leader").collect()}
    for g in range(3):
        h = [x[4] & (1 << 64) - 1 for x in rows if x[0] == g]
        pairs = [1 - (a ^ b).bit_count() / 64 for i, a in enumerate(h) for b in h[i + 1 :]]
        assert (got[g].start_time, got[g].end_time) == (10.0 * g, 10.0 * g + 15)
        assert got[g].confidence == pytest.approx(sum(pairs) / len(pairs))
    assert got[9].confidence == 0


def test_multi_hash_bounds_cover_shifted_members(spark):
    frames, names = planted(spark, at=(20, 26, 31))
    found = detectors.multi_hash(frames, names, CFG).collect()
    assert min(s.start_time for s in found) == 20 and max(s.end_time for s in found) == 55 and {s.confidence for s in found} == {1.0}


def test_audio_hash_detectors(spark):
    frames, names = planted(spark, at=(20, 20, 20))
    found = detectors.spectral_hash(frames, names, CFG).collect()
    assert [(s.start_time, s.end_time, s.match_type) for s in found] == [(20, 44, "audio")]
    assert detectors.cross_correlation(frames, names, CFG).count() >= 1
    land = frames.select("episode_id", "ts", "hash")
    found = detectors.chromaprint(land, names, CFG).collect()
    assert len(found) == 1 and len(found[0].episode_list) == 3
    assert detectors.AUDIO_DETECTORS["fingerprint"] is detectors.spectral_hash


def test_vector_detectors(spark):
    frames, names = planted(spark, length=70, at=(30, 30, 30), run=30)
    vector = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: (F.shiftright(F.col("hash"), 4) % (i + 7)).cast("float"))
    bands = frames.select("episode_id", "frame_idx", "ts", vector.alias("bands"), F.lit(1.0).alias("rms_energy"))
    assert detectors.energy_bands(bands, names, DetectConfig(threshold=3, min_duration=3.0), width=8, stride=2).count() >= 1
    feats = frames.select("episode_id", "frame_idx", "ts", vector.alias("coefficients"), vector.alias("deltas"), vector.alias("delta_deltas"))
    assert detectors.mfcc(feats, names, DetectConfig(threshold=3, min_duration=3.0), width=8, stride=2).count() >= 1
    assert detectors.spectral_v2(frames, names, DetectConfig(threshold=3, min_duration=3.0), width=8).count() >= 1


def test_fusion(spark):
    frames, names = planted(spark, at=(20, 20, 20))
    video, audio = detectors.current(frames, names, CFG), detectors.spectral_hash(frames, names, CFG)
    fused = detectors.fuse(video, audio).collect()
    assert [s.match_type for s in fused] == ["audio+video"] and fused[0].video_confidence is not None
    assert detectors.fuse(video, None).count() == 1 and detectors.fuse(None, audio).count() == 1


def seg_rows(spark, rows):
    from refrain.operators.folds import SEGMENT_SCHEMA

    data = [(f, float(s), float(e), [f"e{i}" for i in range(n)], None, 1.0, None, None, "video") for f, s, e, n in rows]
    return spark.createDataFrame(data, f"fixture string, {SEGMENT_SCHEMA}")


def test_metric_baseline(spark):
    found = seg_rows(spark, [("legacy_no_expectations", 0, 5, 2), ("miss_all", 100, 110, 2), ("perfect_align", 2, 12, 3)])
    wanted = spark.createDataFrame([("miss_all", 0.0, 10.0, 2), ("perfect_align", 2.0, 12.0, 3)], "fixture string, start_time double, end_time double, min_episodes int")
    got = {r.fixture: (r.precision, r.recall, r.f1_score, r.timing_mean_abs_error_ms) for r in evaluate.evaluate(found, wanted).collect()}
    assert got == {"legacy_no_expectations": (1, 1, 1, 0), "miss_all": (0, 0, 0, 100000), "perfect_align": (1, 1, 1, 0)}
    assert evaluate.score_lists([], [])[:4] == (1, 1, 1, 0)


def test_comparison(spark):
    wanted = spark.createDataFrame([("f", 2.0, 12.0, 2)], "fixture string, start_time double, end_time double, min_episodes int")
    report = evaluate.compare_algorithms({"good": seg_rows(spark, [("f", 2, 12, 3)]), "bad": seg_rows(spark, [("f", 90, 99, 3)])}, wanted, {"old": "not supported"})
    best = evaluate.leaders(report).first()
    assert best.best_f1 == "good" and best.best_timing == "good" and report.filter("error is not null").count() == 1
    parts = evaluate.compare_results(seg_rows(spark, [("f", 0, 10, 1), ("f", 20, 30, 1)]), seg_rows(spark, [("f", 0, 10, 1), ("f", 40, 50, 1)]))
    assert {r.part: r.n for r in parts.collect()} == {"common": 1, "only_a": 1, "only_b": 1}


def test_run_store(spark, tmp_path):
    folder = f"file://{tmp_path}/store"
    assert run_store.runs(spark, folder).count() == 0
    columns = "fixture_path string, precision double, recall double, f1_score double, timing_mean_abs_error_ms double, true_positives long, false_positives long, false_negatives long, segments_detected long"
    for k, f1 in enumerate((0.5, 0.75)):
        metrics = spark.createDataFrame([("a.json", 1.0, 1.0, f1, 0.0, 1, 0, 0, 1), ("a.json", 1.0, 1.0, f1, 0.0, 1, 0, 0, 1)], columns)
        assert run_store.record_run(spark, folder, metrics, label=f"run {k}") == k + 1
    assert [r.id for r in run_store.list_runs(run_store.runs(spark, folder), 1).collect()] == [2]
    assert tuple(run_store.last_two(run_store.results(spark, folder)).first()) == ("a.json", 0.5, 0.75)
    assert run_store.latest(run_store.results(spark, folder)).first().latest == 0.75
    assert run_store.joined(run_store.results(spark, folder), run_store.runs(spark, folder)).count() == 2


def test_media_scan_and_fixtures(spark, tmp_path):
    for name in ("b.MKV", "A.mp4", "notes.txt", "sub/c.avi", "sub/Truncated/d.avi"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    assert [r.name for r in media.discover_videos(spark, str(tmp_path)).collect()] == ["A.mp4", "b.MKV"]
    assert [r.name for r in media.discover_videos(spark, str(tmp_path), recursive=True).collect()] == ["A.mp4", "b.MKV", "c.avi"]
    doc = '{"test_name":"t","files":["a","b"],"expected_segments":[{"segment_id":1,"start_time":"1:30.0","end_time":100,"files":["a","b"]},{"segment_id":"2","start_time":"5s","end_time":"3s","files":["a"]}]}'
    (tmp_path / "segments.json").write_text(doc)
    rows = media.fixture_segments(spark, str(tmp_path / "segments.json"))
    assert [(r.start_time, r.end_time, r.min_episodes) for r in rows.orderBy("segment_id").collect()] == [(90.0, 100.0, 2), (5.0, 3.0, 1)]
    assert [r.reason for r in media.validate_fixtures(rows).collect()] == ["it ends before it starts"]


def test_reports(spark):
    import json

    found = detectors.current(*planted(spark, at=(20, 20, 20)), CFG)
    status = spark.createDataFrame([("a", "Completed", 3.0), ("b", "Failed", 1.0)], "name string, state string, elapsed double")
    summary = json.loads(reports.json_summary(found, status).first()[0])
    assert summary["schema_version"] == 1 and summary["failures"] == ["b"] and summary["segments"][0]["audio_confidence"] is None
    empty = json.loads(reports.json_summary(found.limit(0), status.filter("state = 'Completed'")).first()[0])
    assert empty["segments"] == [] and "failures" not in empty
    assert reports.text_summary(found).first().line.startswith("20.0s - 44.0s [video] ep0, ep1, ep2")
    episodes = spark.createDataFrame([(0, 100.0), (1, 50.0), (2, 10.0)], "episode_id int, duration double")
    removed = spark.createDataFrame([(0, 20.0, 44.0), (2, 0.0, 10.0)], "episode_id int, start_time double, end_time double")
    plan = {(r.episode_id, r.action, r.arguments) for r in reports.cut_plan(removed, episodes).collect()}
    assert plan == {(0, "cut", "-ss 0.000 -to 20.000 -c copy"), (0, "cut", "-ss 44.000 -to 100.000 -c copy"), (1, "copy", "-c copy"), (2, "empty", "")}
    assert reports.sync_counts(status).first().is_failed == 1


def test_correlation_cursor():
    shared = list(range(100, 112))
    assert detectors.correlation_matches([1] * 12 + shared, [2] * 12 + shared, 12)[-1] == (12, 12, 1.0)


def test_mfcc_finds_endings_of_long_sequences_at_their_times(spark):
    rng = np.random.default_rng(9)
    shared, rows = rng.normal(size=(60, 3)), []
    starts = {1: 905, 2: 931, 3: 920}
    for ep, at in starts.items():
        v = rng.normal(size=(1000, 3)) * 5 + 40 * ep
        v[at : at + 60] = shared
        rows += [(ep, i, float(i), x.tolist(), x.tolist(), x.tolist()) for i, x in enumerate(v)]
    feats = spark.createDataFrame(rows, "episode_id long, frame_idx long, ts double, coefficients array<double>, deltas array<double>, delta_deltas array<double>")
    names = spark.createDataFrame([(e, f"e{e}") for e in starts], "episode_id long, name string")
    wide = windows.vector_windows(detectors.end_regions(feats.withColumn("value", F.col("coefficients"))), "value", 20, 1)
    assert wide.filter("end_time - start_time <> 19").count() == 0  # none crosses from the beginning into the ending
    assert wide.groupBy("episode_id", "region").count().filter("count <> 100").count() == 0
    found = detectors.mfcc(feats, names, DetectConfig(threshold=3, min_duration=15.0), width=20, stride=1).collect()
    assert len(found) == 1 and found[0].start_time == 905.0 and found[0].end_time == 990.0
    assert {t.episode_name: (t.start_time, t.end_time) for t in found[0].episode_timings} == {f"e{e}": (float(at), float(at + 59)) for e, at in starts.items()}


def test_jvm_regions_equal_the_plain_fold(spark):
    rng = np.random.default_rng(3)
    rows = [(1, 2, float(t), float(t + rng.integers(-1, 2))) for t in np.sort(rng.choice(400, 150, replace=False))]
    matches = spark.createDataFrame(rows, "ep1 long, ep2 long, t1 double, t2 double")
    got = sorted((r.start1, r.end1, r.start2, r.end2, r.match_count) for r in joins.landmark_regions(matches).collect())
    assert got == sorted(joins.dense_regions([(a, b) for *_, a, b in rows])) and got


def test_pairs_are_dealt_once(spark):
    one = spark.range(50).selectExpr("id as a", "id % 3 as k")
    two = spark.range(70).selectExpr("id as b", "id % 5 as l")
    got = joins.dealt_pairs(one, two, F.col("a") < F.col("b"), 7).select("a", "b").collect()
    assert sorted(map(tuple, got)) == [(a, b) for a in range(50) for b in range(70) if a < b]


def test_series_are_apart(spark):
    """Two series in one table give what each gives alone, though both hold the same run."""
    one, names = planted(spark, at=(20, 20, 20))
    other = one.filter("episode_id < 2").select((F.col("episode_id") + 10).alias("episode_id"), "frame_idx", "ts", "hash")
    both = one.unionByName(other)
    known = names.withColumn("series", F.lit(1)).unionByName(names.filter("episode_id < 2").select((F.col("episode_id") + 10).alias("episode_id"), "name", F.lit(2).alias("series")))
    shown = lambda df: sorted((r.start_time, r.end_time, tuple(r.episode_list)) for r in df.collect())
    for detector in (detectors.current, detectors.multi_hash, detectors.spectral_hash, detectors.chromaprint):
        found = detector(both, known, CFG)
        assert shown(found.filter("series = 1")) == shown(detector(one, names, CFG)) != []
        assert shown(found.filter("series = 2")) == []  # two sequences, three wanted
    two = DetectConfig(threshold=2, min_duration=5.0, similarity_threshold=1.0, window_frames=6)
    found = detectors.current(both, known, two)
    assert shown(found.filter("series = 2")) == shown(detectors.current(other, names.select((F.col("episode_id") + 10).alias("episode_id"), "name"), two)) != []


def test_duplicate_links_join_what_pairs_join(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 60, 40).tolist()
    near = base[:5] + [7] + base[6:]
    rows = [(e, i, float(i), h) for e, seq in enumerate([base, base, near, near, base, rng.integers(0, 1 << 60, 40).tolist()]) for i, h in enumerate(seq)]
    frames = spark.createDataFrame(rows, "episode_id int, frame_idx int, ts double, hash long")
    sampled = windows.identity_sample(frames)
    from refrain.operators.components import components

    got = {r.node: r.component for r in components(joins.duplicate_links(sampled)).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0} and joins.duplicate_links(sampled).count() == 4


def test_first_fit_takes_the_earliest_leader(spark):
    words = spark.createDataFrame([(0, 0b0000), (1, 0b1111), (2, 0b0111)], "id long, hash long")
    nearest = {r.id: r.leader for r in joins.leader_clusters(words, 3).collect()}
    first = {r.id: r.leader for r in joins.leader_clusters(words, 3, first_fit=True).collect()}
    assert nearest == {0: 0, 1: 1, 2: 1} and first == {0: 0, 1: 1, 2: 0}

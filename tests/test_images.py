import numpy as np
import pytest
from pyspark.sql import functions as F

from refrain.functions import images
from refrain.sources.sequences import emb_frames

RNG = np.random.default_rng(3)


def test_color_hash_by_hand():
    px = RNG.integers(0, 256, (8, 8, 3))
    h = 0
    for r, g, b in px.reshape(-1, 3).tolist():
        h = h * 31 % 2**64
        means = [int(px[..., c].sum()) // 64 for c in range(3)]
        h |= (r > means[0]) | (g > means[1]) << 1 | (b > means[2]) << 2
    assert images.color_hash(px) % 2**64 == h


def test_keypoints_on_a_grid():
    grey = np.zeros((128, 160))
    assert len(images.keypoints(grey)[0]) == 0
    grey[:, 65:] = 255
    found, patches = images.keypoints(grey)
    assert found[:, 0].tolist() == [64.0, 64.0] and patches.shape == (2, 25)


def features(n, seed):
    rng = np.random.default_rng(seed)
    return [images.frame_features(float(i), rng.integers(0, 256, (128, 128)), rng.integers(0, 256, (64, 64))) for i in range(n)]


def test_alignment_finds_the_shift():
    f = features(40, 1)
    one, two = f[6:36], f[0:30]
    r1, r2, score = images.align(one, two, 10)
    assert r1 == (6.0, 29.0) and r2 == (6.0, 29.0) and score == pytest.approx(0.96, abs=0.05)
    assert images.align(one[:5], two, 10) is None and images.align([], two, 10) is None


def test_hashes_and_pairs(spark):
    h = images.multi_scale_hash(RNG.integers(0, 256, (8, 9)), RNG.integers(0, 256, (8, 8)), RNG.integers(0, 256, (8, 8, 3)), 7)
    assert set(h) == {"dhash", "phash", "ahash", "color_hash"} and all(-(1 << 63) <= v < 1 << 63 for v in h.values())
    packed = emb_frames(spark, "/root/testdata/sf0.001").groupBy("episode_id").agg(F.array_sort(F.collect_list(F.struct("ts", F.col("embedding").alias("signature")))).alias("f"))
    pairs = packed.select(F.col("episode_id").alias("ep1"), F.col("f").alias("f1")).crossJoin(packed.select(F.col("episode_id").alias("ep2"), F.col("f").alias("f2"))).filter("ep1 = ep2")
    assert all(r.score == pytest.approx(0.6) and r.start1 == r.start2 for r in images.align_pairs(pairs, 3).collect())

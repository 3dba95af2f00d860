import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from refrain.config import DetectConfig, effective_threshold, window_size
from refrain.functions import dsp, hashing, similarity, text

MASK = (1 << 64) - 1


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def plain_window(words):
    h = 0
    for v in words:
        h = ((h * hashing.PRIME + v) & MASK) % hashing.MODULUS
    return h


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_hamming_vectors(spark):
    row = one(spark, *[hashing.hamming(F.lit(0b1010), F.lit(x)) for x in (0b1010, 0b1000, 0b0101, 0b1011)], hashing.hamming(F.lit(0), F.lit(-1)))
    assert list(row) == [0, 1, 4, 1, 64]


def test_window_hash_is_exact_for_unsigned_words(spark):
    rng = random.Random(4)
    words = [[rng.choice([rng.getrandbits(64), MASK - rng.getrandbits(8), rng.getrandbits(20)]) for _ in range(5)] for _ in range(500)]
    frame = spark.createDataFrame([(i, [signed(v) for v in w]) for i, w in enumerate(words)], "i int, w array<long>")
    got = dict(frame.select("i", hashing.window_hash(F.col("w"))).collect())
    assert got == {i: plain_window(w) for i, w in enumerate(words)}


def test_multi_hash_similarity_bounds(spark):
    a = hashing.synthetic_hashes(F.lit(0).cast("long"))
    b = hashing.synthetic_hashes(F.lit(-1).cast("long"))
    assert list(one(spark, hashing.weighted_similarity(a, a), hashing.weighted_similarity(a, b))) == pytest.approx([1.0, 0.0])


def test_adaptive_threshold(spark):
    empty = similarity.adaptive_threshold(0.82, F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(None).cast("double"))
    some = similarity.adaptive_threshold(0.99, F.lit(0.1), F.lit(0.0), F.lit(0.0))
    got = one(spark, empty, some)
    assert got[0] == pytest.approx(0.82) and 0.5 <= got[1] <= 0.95


def test_effective_threshold_and_windows():
    assert [effective_threshold(*x) for x in ((3, 2), (10, 3), (3, 5), (2, 5), (0, 3), (3, 0))] == [2, 3, 3, 2, 1, 3]
    assert window_size(15, 2.0) == 3 and window_size(100, 2.0) == 10 and window_size(100, 12.0) == 12 and window_size(100, 5.0, "audio") == 5
    assert DetectConfig(similarity_threshold=0.75).max_distance == 16


def test_level_similarity(spark):
    a = [0, 1, 2, 3, 2, 1, 0]
    arr = lambda v: F.array(*[F.lit(x) for x in v])
    got = one(spark, *[similarity.level_similarity(arr(a), arr(b)) for b in (a, [0, 2, 2, 3, 2, 1, 0], [3, 3, 3, 0, 0, 0, 3], [1])])
    assert got[0] == 1.0 and got[1] > 0.85 and got[2] < 0.3 and got[3] == 0.0


def test_equal_share(spark):
    arr = lambda v: F.array(*[F.lit(x) for x in v])
    got = one(spark, similarity.equal_share(arr([1, 2, 3, 4, 5]), arr([1, 2, 3, 4, 5])), similarity.equal_share(arr([1, 2, 3, 4, 5]), arr([1, 2, 9, 4, 5])))
    assert list(got) == [1.0, 0.8]


def test_times(spark):
    got = one(spark, text.format_time(F.lit(12.3)), text.format_time(F.lit(125.0)), text.format_elapsed(F.lit(75.9)), *[text.parse_time_token(F.lit(t)) for t in ("12.5", "12.5s", "1:30.5", "1:02:03", "x")])
    assert list(got) == ["12.3s", "2:05.0", "[01:15]", 12.5, 12.5, 90.5, 3723.0, None]


def test_time_shift_flag(spark):
    assert list(one(spark, similarity.time_shifted(F.array(F.lit(10.0), F.lit(10.5))), similarity.time_shifted(F.array(F.lit(10.0), F.lit(15.0))))) == [False, True]


def test_block_signature_matches_numpy(spark):
    rng = np.random.default_rng(0)
    px = rng.integers(0, 256, (64, 64))
    got = spark.createDataFrame([(px.ravel().tolist(),)], "p array<int>").select(similarity.block_signature(F.col("p"))).first()[0]
    blocks = px.reshape(8, 8, 8, 8).swapaxes(1, 2).reshape(64, 64)
    want = np.column_stack([blocks.mean(axis=1) / 255, blocks.var(axis=1) / 255**2]).ravel()
    assert np.allclose(got, want)


def tone(hz, rate=22050, seconds=1.0):
    return np.sin(2 * np.pi * hz * np.arange(int(rate * seconds)) / rate).astype(np.float32)


def test_spectral_features_of_a_tone():
    (_, centroid, rolloff, bins, energy) = dsp.spectral_features(tone(440)[:8192], 22050)[0]
    assert 400 < centroid < 500 and 400 < rolloff < 500 and len(bins) == 8 and energy > 0


def test_feature_kernels():
    x = tone(440) + 0.5 * tone(1800)
    assert dsp.landmarks(x, 22050) and all(0 <= h < 1 << 12 for _, h in dsp.landmarks(x, 22050))
    c = dsp.mfcc(x, 22050)
    d, dd = dsp.delta_features(c)
    assert c.shape[1] == 13 and d.shape == c.shape == dd.shape
    assert (dsp.spectral_hash(x, 22050) != 0).all()
    assert dsp.energy_bands(x, 22050)[0].shape[1] == 12
    assert dsp.mel_fingerprint(x[:100], 22050).tolist() == [0] * 12
    assert dsp.mel_inverse(dsp.mel(1000.0)) == pytest.approx(1000.0, abs=1)


def test_kernels_over_samples(spark):
    rows = spark.createDataFrame([(0, 22050.0, tone(440).tolist()), (1, 22050.0, None)], "episode_id int, sample_rate double, samples array<float>")
    assert dsp.landmark_frames(rows).filter("episode_id = 0").count() > 0
    assert dsp.mfcc_frames(rows).count() == (22050 - 2048) // 512 + 1
    assert dsp.energy_frames(rows).count() == (22050 - 4096) // 1024 + 1
    assert dsp.spectral_hash_frames(rows).count() == (22050 - 8192) // 2048 + 1
    assert dsp.legacy_frames(rows).select("hash").first()[0] >= 0

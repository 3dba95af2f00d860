"""Similarities of vectors, signatures, intervals and level sequences as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _doubles(values: Column) -> Column:
    return F.transform(values, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y))


def cosine(a: Column, b: Column) -> Column:
    """S-15, S-16: 0 for arrays of unequal length or without a norm."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norms == 0), F.lit(0.0)).otherwise(dot(a, b) / norms)


def global_ssim(a: Column, b: Column) -> Column:
    """S-14: structural similarity of two grey images (arrays of 0-255), with the constants as published: not squared."""
    n = F.size(a).cast("double")
    c1, c2 = 0.01 * 255 * 255, 0.03 * 255 * 255
    ma, mb = _sum(_doubles(a)) / n, _sum(_doubles(b)) / n
    va, vb = dot(a, a) / n - ma * ma, dot(b, b) / n - mb * mb
    cov = dot(a, b) / n - ma * mb
    bottom = (ma * ma + mb * mb + c1) * (va + vb + c2)
    return F.when(bottom == 0, F.lit(0.0)).otherwise((2 * ma * mb + c1) * (2 * cov + c2) / bottom)


def block_signature(pixels: Column, side: int = 64, block: int = 8) -> Column:
    """S-11: mean/255 and variance/255**2 of each block of a square grey image, blocks in reading order."""
    per = side // block

    def part(k: Column) -> Column:
        top, left = F.floor(k / per) * block, (k % per) * block
        rows = F.transform(F.sequence(F.lit(0), F.lit(block - 1)), lambda r: F.slice(pixels, ((top + r) * side + left + 1).cast("int"), F.lit(block)))
        values = _doubles(F.flatten(rows))
        mean = _sum(values) / (block * block)
        var = _sum(F.transform(values, lambda x: (x - mean) * (x - mean))) / (block * block)
        return F.array(mean / 255.0, var / (255.0 * 255.0))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(per * per - 1)), part))


def keypoint_match(n1: Column, n2: Column) -> Column:
    """S-17 in closed form, for descriptors that are multiples of one another: 0.9 n1 / max(n1, n2), if at least a fifth match."""
    ratio = n1 / F.greatest(n1, n2)
    return F.when((n1 > 0) & (n2 > 0) & (ratio >= 0.2), 0.9 * ratio).otherwise(F.lit(0.0))


def level_similarity(a: Column, b: Column) -> Column:
    """S-27: share of places where two level sequences differ by one at most; 0 if their lengths differ."""
    near = F.zip_with(a, b, lambda x, y: F.when(F.abs(x - y) <= 1, 1.0).otherwise(0.0))
    return F.when((F.size(a) != F.size(b)) | (F.size(a) == 0), F.lit(0.0)).otherwise(_sum(near) / F.size(a))


def time_overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """S-22: intersection over union of two intervals."""
    common = F.least(e1, e2) - F.greatest(s1, s2)
    union = F.greatest(e1, e2) - F.least(s1, s2)
    return F.when((common <= 0) | (union <= 0), F.lit(0.0)).otherwise(common / union)


def sequence_overlap(a: Column, b: Column) -> Column:
    """S-23: members of ``a`` that are in ``b``, over the shorter list."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least == 0, F.lit(0.0)).otherwise(F.size(F.filter(a, lambda x: F.array_contains(b, x))) / least)


def equal_share(a: Column, b: Column) -> Column:
    """Share of places at which two arrays agree (the correlation of hash sequences)."""
    least = F.least(F.size(a), F.size(b))
    same = F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)
    return F.when(least == 0, F.lit(0.0)).otherwise(F.size(same) / least)


def mfcc_distance(a: Column, b: Column) -> Column:
    """DSP-13: of two structs (coefficients, deltas, delta_deltas)."""
    parts = F.lit(0.0)
    for field, weight in (("coefficients", 1.0), ("deltas", 0.5), ("delta_deltas", 0.25)):
        parts = parts + weight * _sum(F.zip_with(_doubles(a[field]), _doubles(b[field]), lambda x, y: (x - y) * (x - y)))
    return F.sqrt(parts)


def energy_correlation(a: Column, b: Column) -> Column:
    """DSP-14: of two structs (bands, rms_energy)."""
    norms = F.sqrt(dot(a["bands"], a["bands"])) * F.sqrt(dot(b["bands"], b["bands"]))
    high = F.greatest(a["rms_energy"], b["rms_energy"])
    loud = F.when(high > 0, F.least(a["rms_energy"], b["rms_energy"]) / high).otherwise(F.lit(0.0))
    return F.when(norms < 1e-6, F.lit(0.0)).otherwise(0.8 * dot(a["bands"], b["bands"]) / norms + 0.2 * loud)


def confidence(variance: Column, n: Column) -> Column:
    """S-21: steady durations and many members."""
    return F.least(F.lit(1.0), 0.7 / (1 + variance) + 0.3 * F.least(F.lit(1.0), n / 10.0))


def adaptive_threshold(base: float, complexity: Column, motion: Column, color_variance: Column) -> Column:
    """S-20: lower for complex material, within [0.5, 0.95]; the base without material."""
    lowered = base - 0.1 * (0.3 * complexity + 0.4 * motion + 0.3 * color_variance)
    return F.when(lowered.isNull(), F.lit(base)).otherwise(F.greatest(F.lit(0.5), F.least(F.lit(0.95), lowered)))


def time_shifted(starts: Column) -> Column:
    """S-28: some start is over two seconds from the first one."""
    return F.exists(starts, lambda s: F.abs(s - F.get(starts, F.lit(0))) > 2.0)


def hz_to_mel(hz: Column) -> Column:
    """S-26."""
    return 2595.0 * F.log10(1 + hz / 700.0)


def mel_to_hz(mel: Column) -> Column:
    return 700.0 * (F.pow(F.lit(10.0), mel / 2595.0) - 1)

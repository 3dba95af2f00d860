"""Hash and bit functions as column expressions. 64-bit words are signed longs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the polynomial window hash: multiplier, modulus, and 2**64 modulo the modulus.
PRIME, MODULUS, WRAP = 1_000_000_007, 1_000_000_009, 688_856_453
# Fixed values of the weighted multi-hash similarity: difference, perceptual, average, colour.
WEIGHTS = (0.35, 0.30, 0.20, 0.15)


def hamming(a: Column, b: Column) -> Column:
    """S-1."""
    return F.bit_count(a.bitwiseXOR(b))


def is_similar(a: Column, b: Column, radius: int) -> Column:
    """S-2."""
    return hamming(a, b) <= radius


def hamming_similarity(a: Column, b: Column) -> Column:
    """S-3: 1 - distance / 64."""
    return 1 - hamming(a, b) / F.lit(64.0)


def weighted_similarity(a: Column, b: Column, parts: tuple[str, ...] = ("dhash", "phash", "ahash", "color_hash")) -> Column:
    """S-10: weighted similarity of two structs of hashes."""
    total = F.lit(0.0)
    for part, weight in zip(parts, WEIGHTS, strict=True):
        total = total + weight * hamming_similarity(a[part], b[part])
    return total


def text_hash(text: Column) -> Column:
    """60 bits of the MD5 of a string."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def sign_bits(vector: Column) -> Column:
    """Bit i is set where component i is positive (at most 64 components)."""
    return _bits(F.transform(vector, lambda x: x > 0))


def roll(h: Column, v: Column) -> Column:
    """One step of the window hash for any 64-bit word, exact under unsigned wrap-around and free of overflow."""
    step = h * PRIME + v
    return (
        F.when(v >= 0, (h * PRIME % MODULUS + v % MODULUS) % MODULUS)
        .when(step >= 0, step % MODULUS)
        .otherwise((F.pmod(step, F.lit(MODULUS).cast("long")) + WRAP) % MODULUS)
    )


def window_hash(values: Column) -> Column:
    """S-4: the hash of an array of words, first to last."""
    return F.aggregate(values, F.lit(0).cast("long"), roll)


def rotate_left(h: Column, bits: int) -> Column:
    return F.shiftleft(h, bits).bitwiseOR(F.shiftrightunsigned(h, 64 - bits))


def synthetic_hashes(h: Column) -> Column:
    """S-24: the four variants that the multi-hash detector makes of one word."""
    return F.struct(
        rotate_left(h, 1).bitwiseXOR(F.lit(-0x5555555555555556)).alias("dhash"),
        h.alias("phash"),
        rotate_left(h, 62).bitwiseXOR(F.lit(0x5555555555555555)).alias("ahash"),
        rotate_left(h, 3).bitwiseXOR(F.lit(0x3333333333333333)).alias("color_hash"),
    )


def unsigned(h: Column) -> Column:
    """A signed long read as an unsigned one, as a double."""
    return F.when(h < 0, h.cast("double") + F.lit(2.0**64)).otherwise(h.cast("double"))


def synthetic_signature(h: Column) -> Column:
    """S-25: four numbers between 0 and 1."""
    return F.array(
        unsigned(h) / F.lit(2.0**64),
        F.shiftrightunsigned(h, 32).cast("double") / F.lit(2.0**32 - 1),
        h.bitwiseAND(F.lit(0xFFFFFFFF)).cast("double") / F.lit(2.0**32 - 1),
        F.shiftrightunsigned(h, 16).bitwiseAND(F.lit(0xFFFF)).cast("double") / F.lit(65535.0),
    )


def placeholder_hash(width: Column, height: Column, first16: Column) -> Column:
    """S-5: of a frame's size and its first sixteen bytes (array of ints)."""
    zipped = F.transform(F.slice(first16, 1, 16), lambda b, i: b.cast("long") * F.pow(F.lit(2.0), F.pmod(i, F.lit(8))).cast("long"))
    return ((width.cast("long") * 31) + height) * 31 + F.aggregate(zipped, F.lit(0).cast("long"), lambda a, x: a + x)


def average_hash(pixels: Column) -> Column:
    """S-7: bit i is set where grey pixel i of 64 exceeds the integer mean."""
    mean = F.floor(F.aggregate(pixels, F.lit(0).cast("long"), lambda a, x: a + x) / F.size(pixels))
    return _bits(F.transform(pixels, lambda p: p > mean))


def difference_hash(pixels: Column) -> Column:
    """S-6: bit y * 8 + x is set where a pixel of a 9 x 8 grey image (72 values) is brighter than its right neighbour."""
    spots = F.sequence(F.lit(0), F.lit(63))
    return _bits(F.transform(spots, lambda i: F.get(pixels, (F.floor(i / 8) * 9 + i % 8).cast("int")) > F.get(pixels, (F.floor(i / 8) * 9 + i % 8 + 1).cast("int"))))


def _bits(flags: Column) -> Column:
    powers = F.transform(flags, lambda f, i: F.when(f, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(powers, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))

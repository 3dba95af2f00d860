"""Hashed word shingles of whole texts, and their circulant MinHash.

Words are runs of characters other than ASCII white space, with A-Z folded. Hashes have 64
bits; sets of hashes stand for sets of shingles.

Circulant MinHash: one permutation sigma scatters the elements over a ring of ``RING``
places, a second one, pi, ranks the places. Coordinate k of a signature is the smallest
rank after pi has been turned by k places. So two tables make all coordinates, and an
element's ranks under all of them lie side by side in memory.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

RING = 1 << 20
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in a row, and how many belong to each text."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = parts.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    table = np.fromiter((xxhash.xxh3_64_intdigest(w.encode()) for w in words), np.uint64, len(words))
    index = coded.indices.to_numpy(zero_copy_only=False)
    hashes = table[index]
    if "" in words:  # leading and trailing white space
        real = index != words.index("")
        owner = np.repeat(np.arange(len(counts)), counts)[real]
        return hashes[real], np.bincount(owner, minlength=len(counts)).astype(np.int64)
    return hashes, counts


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of ``n`` words of one text; a shorter text is one run."""
    if not len(words):
        return words
    n = min(n, len(words))
    m = len(words) - n + 1
    h = np.full(m, n, np.uint64)
    for k in range(n):
        h = mix((h + words[k : k + m]) * _M1)
    return h


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    return [np.unique(shingle_hashes(hashes[e - c : e], n)) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]


def set_digest(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


@lru_cache(maxsize=2)
def _tables(width: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    sigma = rng.permutation(RING).astype(np.uint32)
    pi = rng.permutation(RING).astype(np.uint32)
    turned = np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[: width - 1]]), width)
    return sigma, turned


def signature(hashes: np.ndarray, width: int, seed: int = 7) -> np.ndarray:
    """``width`` coordinates of a non-empty set."""
    sigma, turned = _tables(width, seed)
    places = sigma[(hashes >> np.uint64(44)).astype(np.int64)]
    best = turned[places[:1024]].min(axis=0)
    for low in range(1024, len(places), 1024):
        np.minimum(best, turned[places[low : low + 1024]].min(axis=0), out=best)
    return best


def band_hashes(coordinates: np.ndarray, bands: int) -> np.ndarray:
    rows = coordinates.reshape(bands, -1).astype(np.uint64)
    h = np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(rows.shape[1]):
        h = mix((h + rows[:, k]) * _M1)
    return h.view(np.int64)

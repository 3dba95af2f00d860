"""Benchmark decontamination by latent semantic retrieval.

1. Whole texts are coded as positions in the benchmark's vocabulary (other words are gaps)
   and written to the shared folder, 16 or 32 bits a word.
2. Document frequencies of that vocabulary are counted over all passages of
   ``PASSAGE`` words of all documents.
3. The TF-IDF matrix of those passages gets a distributed randomised SVD: every task adds
   its part of ``A'(A G)`` for a Gaussian ``G``, the parts are summed by a shuffle, and
   Nystroem's formula turns the sum into the leading right singular vectors. What reaches
   the driver has the size of the benchmark's vocabulary times ``RANK``.
4. Windows at several scales, a few words apart, are folded into the latent space.
   A window is a candidate for a benchmark item when it carries a share of the item's IDF
   mass and its cosine is high enough.
5. No bound on a cosine is safe, so windows also become candidates by their words: whatever
   is to be confirmed has at least ``HITS`` words among an item's rarest places (all but
   ``needed - HITS`` of them), and windows on the grid that have so many are compared too.
   Items of under ``SHORT`` words are found as runs of their words.
6. A candidate is confirmed on the words themselves: the longest common subsequence has to
   hold ``LCS_SHARE`` of the item's words, and ``ANSWER_SHARE`` of its answer (its last
   sentence), which lets reworded copies through but no passage on the same subject. An item
   of over ``SCALES[-1]`` words is searched by parts of about equal length; a document that
   holds a part is compared with the whole item, around the place where the part was found.

The benchmark is the query set: it is taken in blocks of ``ITEMS`` items, each against all
documents, so what tasks hold has a bound whatever its size.

Words are lower-cased and stripped of punctuation at their ends. Defined results: null or
wordless texts match nothing; a null or wordless item matches nothing; items of under eight
words have to be found whole; repeated rows are each judged, and reported once for an id and
item, by the best match; an empty table, or benchmark, gives an empty result; a row with a
null doc_id is judged and reported like any other. :func:`decontaminate` removes rows by
their own text, whatever their doc_id. Other columns are ignored (:func:`decontaminate`
passes them on).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, discard, materialize, packed, trim, unpacked
from .tokenization import slices

PASSAGE, STRIDE = 32, 8
SCALES = (16, 24, 32, 48, 64, 96, 128)
RANK, OVERSAMPLE = 64, 8
ITEMS = 2000
LEAST_MASS, LEAST_COSINE = 0.5, 0.45
#: How the windows of so many strides are put together from shorter ones.
SPLITS = {2: (1, 1), 3: (2, 1), 4: (2, 2), 6: (4, 2), 8: (4, 4), 12: (8, 4), 16: (8, 8)}
LCS_SHARE, ANSWER_SHARE = 0.6, 0.5
SHORT = 8
#: Words that a window has to have among an item's rarest places, and places looked up at a time.
HITS, LOOKUPS = 3, 1 << 16
#: What a task holds, not what it finds: bytes of text coded at a time, words remembered meanwhile, bytes of coded text
#: searched at a time, windows judged at a time.
CODED_BYTES, MEMO_WORDS = 1 << 20, 50_000
SEARCH_BYTES, JUDGED = 1 << 18, 2048
FOUND = "item_id long, lcs_share double, answer_share double"
MARKS = " \t\n\r\x0b\x0c.,;:!?\"'()[]{}<>|*#$%&-_=+~`^/\\"
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def words_of(text: str | None) -> list[str]:
    return [w for w in (x.strip(MARKS) for x in (text or "").lower().split()) if w]


@dataclass
class Item:
    """An item, or a part of a long one: ``before`` and ``after`` are the item's words around it."""

    item_id: int
    words: list[int]
    answer: list[int]
    before: list[int]
    after: list[int]


class Benchmark:
    """A block of items, coded in their own vocabulary."""

    def __init__(self, rows: list[tuple[int, str | None]]):
        texts = [(i, t) for i, t in rows if words_of(t)]
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for _, t in texts for w in words_of(t)}))}
        self.items = []
        for item_id, text in texts:
            coded = [self.vocabulary[w] for w in words_of(text)]
            last = len(words_of([s for s in _SENTENCE.split(text) if words_of(s)][-1]))
            answer = coded[-last:] if last < len(coded) else coded[-max(1, len(coded) // 4) :]
            parts = -(-len(coded) // SCALES[-1])
            cuts = [len(coded) * k // parts for k in range(parts + 1)]
            for low, high in zip(cuts, cuts[1:], strict=False):
                self.items.append(Item(item_id, coded[low:high], answer, coded[:low], coded[high:]))


def lcs_length(pattern: dict[int, int], length: int, text: list[int]) -> int:
    """Longest common subsequence by bit-parallel dynamic programming; ``pattern``: word -> mask of its places."""
    full = (1 << length) - 1
    v = full
    for w in text:
        m = pattern.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return length - v.bit_count()


def masks(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


def encode(docs: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """(doc_id, ids), whatever type doc_id has: the words of each text as int16/int32 positions in the vocabulary, -1 for others."""
    kind = np.int16 if len(vocabulary) < 32_000 else np.int32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, int] = {}
        for batch in slices(batches, 1, CODED_BYTES):
            parts = pc.ascii_split_whitespace(pc.utf8_lower(pc.fill_null(batch.column(1), "")))
            counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
            coded = parts.flatten().dictionary_encode()
            table = np.empty(len(coded.dictionary), np.int32)
            for i, w in enumerate(coded.dictionary.to_pylist()):
                k = memo.get(w)
                if k is None:
                    bare = w.strip(MARKS)
                    k = vocabulary.get(bare, -1) if bare else -2
                    if len(memo) < MEMO_WORDS:
                        memo[w] = k
                table[i] = k
            ids = table[coded.indices.to_numpy(zero_copy_only=False)] if len(table) else np.empty(0, np.int32)
            real = ids > -2
            owner = np.repeat(np.arange(len(counts)), counts)[real]
            data, ends = ids[real].astype(kind), np.cumsum(np.bincount(owner, minlength=len(counts)))
            out = [data[a:b].tobytes() for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "ids"])
        memo.clear()
        trim()

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary")


def _flat(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a batch, and the bounds of its texts."""
    size = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) // np.dtype(kind).itemsize
    bounds = np.concatenate([[0], np.cumsum(size)])
    return np.frombuffer(b"".join(column.to_pylist()), kind), bounds


def passage_terms(ids: np.ndarray, bounds: np.ndarray, v: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Distinct (passage, term) pairs, their counts, and the number of passages with a word of the vocabulary or not."""
    size = np.diff(bounds)
    per_doc = -(-size // PASSAGE)
    first = np.cumsum(per_doc) - per_doc
    place = np.arange(len(ids)) - np.repeat(bounds[:-1], size)
    passage = np.repeat(first, size) + place // PASSAGE
    known = ids >= 0
    keys = passage[known] * v + ids[known]
    n = int(per_doc.sum())
    keys = np.sort(keys.astype(np.uint32 if n * v < 1 << 32 else np.uint64))
    starts = np.flatnonzero(np.diff(keys, prepend=keys[:1] + 1)) if len(keys) else np.empty(0, np.int64)
    distinct = keys[starts].astype(np.int64)
    return distinct // v, distinct % v, np.diff(np.append(starts, len(keys))), n


def frequencies(coded: DataFrame, v: int, kind: type) -> tuple[np.ndarray, int]:
    """Document frequency of each term over all passages, and the number of passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, total = np.zeros(v, np.int64), 0
        for batch in slices(batches, 0):
            _, term, _, n = passage_terms(*_flat(batch.column(0), kind), v)
            df += np.bincount(term, minlength=v)
            total += n
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1), pa.int64()), pa.array(np.append(df[seen], total), pa.int64())], names=["term", "df"])

    sums = coded.select("ids").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(v + 1, np.int64)
    df[sums["term"].to_numpy()] = sums["df"].to_numpy()
    return df[:v], int(df[v])


def latent_terms(coded: DataFrame, idf: np.ndarray, kind: type, seed: int = 3) -> np.ndarray:
    """Leading right singular vectors (term, rank) of the passages' TF-IDF matrix, each divided by its singular value.

    The division keeps the few directions that all texts of a language share from drowning the rest.
    """
    v = len(idf)
    width = min(v, RANK + OVERSAMPLE)
    gauss = np.random.default_rng(seed).standard_normal((v, width)).astype(np.float32)
    gauss0 = np.vstack([gauss, np.zeros((1, width), np.float32)])
    idf32 = idf.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((v, width))
        for batch in slices(batches, 0, 2 << 20):
            passage, term, count, n = passage_terms(*_flat(batch.column(0), kind), v)
            if not len(term):
                continue
            a = (1 + np.log(count)).astype(np.float32) * idf32[term]
            a = (a / np.sqrt(np.bincount(passage, a * a, n))[passage]).astype(np.float32)
            starts = np.flatnonzero(np.diff(passage, prepend=-1))
            row = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(passage))))
            slot = np.arange(len(term)) - starts[row]
            padded = np.full((len(starts), int(slot.max()) + 1), v)
            share = np.zeros(padded.shape, np.float32)
            padded[row, slot], share[row, slot] = term, a
            product = np.zeros((len(starts), width), np.float32)
            for j in range(padded.shape[1]):
                some = slice(None) if j < 8 else np.flatnonzero(padded[:, j] < v)
                product[some] += gauss0[padded[some, j]] * share[some, j, None]
            order = np.argsort(term.astype(np.uint16) if v <= 1 << 16 else term, kind="stable")
            by_term = np.flatnonzero(np.diff(term[order], prepend=-1))
            row, a = row[order], a[order]
            for low, high in zip(by_term.tolist(), [*by_term[1:].tolist(), len(order)], strict=True):
                out[term[order[low]]] += a[low:high] @ product[row[low:high]]
        some = np.flatnonzero(out.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), *[pa.array(out[some, c], pa.float64()) for c in range(width)]], names=["term", *[f"c{c}" for c in range(width)]])

    schema = ", ".join(["term long", *[f"c{c} double" for c in range(width)]])
    sums = coded.select("ids").mapInArrow(run, schema).groupBy("term").agg(*[F.sum(f"c{c}").alias(f"c{c}") for c in range(width)]).toArrow()
    z = np.zeros((v, width))
    for c in range(width):
        z[sums["term"].to_numpy(), c] = sums[f"c{c}"].to_numpy()
    # Nystroem: A'A is about Z (G'Z)^-1 Z'; a small shift keeps the root real.
    shift = 1e-9 * np.linalg.norm(z) + 1e-12
    z = z + shift * gauss
    core = gauss.T.astype(float) @ z
    root = np.linalg.cholesky((core + core.T) / 2 + 1e-9 * np.trace(core) / width * np.eye(width))
    vectors, values, _ = np.linalg.svd(np.linalg.solve(root, z.T).T, full_matrices=False)
    values = np.maximum(values[:RANK], 1e-6 * values[0])
    return (vectors[:, :RANK] / values * values[0]).astype(np.float32)


def needed(item: Item) -> float:
    """Words of an item that have to be found."""
    n = len(item.words)
    return n if n < SHORT else max(SHORT, LCS_SHARE * n)


def rarest(item: Item, idf: np.ndarray) -> tuple[list[int], int]:
    """Words of which every window that holds ``needed(item)`` of the item's has some, and how many.

    A common subsequence of t words leaves out n - t places, so it meets any n - t + h places h times.
    """
    t = math.ceil(needed(item))
    hits = min(HITS, t)
    places = sorted(item.words, key=lambda w: (-idf[w], w))[: len(item.words) - t + hits]
    return sorted(set(places)), hits


class Postings:
    """The places of each word in a batch of texts."""

    def __init__(self, ids: np.ndarray, v: int):
        known = np.flatnonzero(ids >= 0)
        self.order = known[np.argsort(ids[known], kind="stable")]
        self.count = np.bincount(ids[known], minlength=v)
        self.first = np.cumsum(self.count) - self.count

    def places(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into ``words``, place) of all occurrences."""
        count = self.count[words]
        which = np.repeat(np.arange(len(words)), count)
        return which, self.order[np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.first[words], count)]


def runs_of(words: list[int], ids: np.ndarray, bounds: np.ndarray, postings: Postings) -> np.ndarray:
    """The texts that hold ``words`` one after the other."""
    anchor = min(range(len(words)), key=lambda j: postings.count[words[j]])
    start = postings.places(np.array([words[anchor]]))[1] - anchor
    text = np.searchsorted(bounds, start + anchor, "right") - 1
    inside = (start >= bounds[text]) & (start + len(words) <= bounds[text + 1])
    start, text = start[inside], text[inside]
    for j, w in enumerate(words):
        same = ids[start + j] == w
        start, text = start[same], text[same]
    return np.unique(text)


def _search(coded: DataFrame, bench: Benchmark, idf: np.ndarray, latent: np.ndarray, kind: type) -> DataFrame:
    vectors = latent * idf[:, None].astype(np.float32)
    idf32 = idf.astype(np.float32)
    groups = []
    for below, s in zip((0, *SCALES), SCALES, strict=False):
        rows = [r for r, i in enumerate(bench.items) if below < len(i.words) <= s]
        own = [bench.items[r] for r in rows]
        if own:
            q = np.array([vectors[i.words].sum(axis=0) for i in own])
            q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)
            mass = np.array([idf32[i.words].sum() for i in own], np.float32)
            groups.append((s, own, np.array(rows), q.astype(np.float32), mass, [masks(i.words) for i in own], [masks(i.answer) for i in own]))
    keys = []  # by group: the looked-up (item, word) pairs, item by item, and the hits each item needs
    for _, own, *_ in groups:
        found = [rarest(i, idf) if len(i.words) >= SHORT else ([], 1) for i in own]
        keys.append((np.repeat(np.arange(len(own)), [len(w) for w, _ in found]), np.array([x for w, _ in found for x in w], np.int64), np.array([h for _, h in found])))

    v = len(idf)
    # (item, word) pairs in order, a key each; the gap word -1 gives a key that no item has.
    member = np.unique(np.concatenate([r * (v + 1) + np.unique(i.words) for r, i in enumerate(bench.items)]).astype(np.int64))
    edge = PASSAGE // 2
    vectors0 = np.vstack([vectors, np.zeros((1, vectors.shape[1]), np.float32)]).astype(np.float32)
    idf0 = np.append(idf32, np.float32(0))
    widest = max(g[0] for g in groups) // STRIDE

    def confirm(ids: np.ndarray, low: int, high: int, ends: tuple[int, int], item: Item, pattern: dict[int, int], answer: dict[int, int]) -> tuple[float, float] | None:
        """A window, places ``low`` to ``high`` of ``ids``, of a text that has the places ``ends``."""
        window = ids[low:high].tolist()
        common, n = lcs_length(pattern, len(item.words), window), len(item.words)
        if common < needed(item):
            return None
        if item.before or item.after:
            whole = [*item.before, *item.words, *item.after]
            # As much text on each side as the item has words there, and half as much again.
            low, high = max(ends[0], low - len(item.before) * 3 // 2), min(ends[1], high + len(item.after) * 3 // 2)
            window, n = ids[low:high].tolist(), len(whole)
            common = lcs_length(masks(whole), n, window)
            if common < LCS_SHARE * n:
                return None
        share = lcs_length(answer, len(item.answer), window) / len(item.answer)
        return (common / n, share) if share >= ANSWER_SHARE else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, SEARCH_BYTES):
            ids, bounds = _flat(batch.column(1), kind)
            size = np.diff(bounds)
            # Texts are laid out in whole strides, with empty ones behind them, so no window reaches the next text.
            real = -(-size // STRIDE)
            strides = real + widest
            first = np.cumsum(strides) - strides
            total = int(strides.sum())
            laid = np.full(total * STRIDE, v, np.int64)
            laid[np.arange(len(ids)) + np.repeat(first * STRIDE - bounds[:-1], size)] = np.where(ids < 0, v, ids)
            laid = laid.reshape(total, STRIDE)
            sums, mass = {1: vectors0[laid[:, 0]]}, {1: idf0[laid].sum(axis=1)}
            for j in range(1, STRIDE):
                sums[1] += vectors0[laid[:, j]]
            for k, (a, b) in SPLITS.items():
                if k <= widest:
                    sums[k], mass[k] = sums[a].copy(), mass[a].copy()
                    sums[k][: total - a] += sums[b][a:]
                    mass[k][: total - a] += mass[b][a:]
            of = np.repeat(np.arange(len(size)), strides)
            place_in = np.arange(total) - first[of]
            padded = np.append(ids, np.full(1, -1, kind))
            best: dict[tuple[int, int], tuple[float, float]] = {}
            postings = Postings(ids, v)
            for (scale, own, which, queries, masses, patterns, answers), (key_item, key_word, hits) in zip(groups, keys, strict=True):
                k = scale // STRIDE
                step = max(1, k // 4)
                weight = mass[k]
                heavy = np.flatnonzero((weight >= LEAST_MASS * masses.min()) & (place_in % step == 0))
                need = np.array([needed(i) for i in own])

                def judge(w, q, scale=scale, own=own, which=which, patterns=patterns, answers=answers, need=need):
                    """Windows at strides ``w`` against items ``q``."""
                    # No common subsequence is longer than the window's words that the item has at all.
                    d = of[w]
                    start = bounds[d] + (w - first[d]) * STRIDE
                    from_, to = np.maximum(start - edge, bounds[d]), np.minimum(start + scale + edge, bounds[d + 1])
                    span = from_[:, None] + np.arange(scale + 2 * edge)
                    word = padded[np.where(span < to[:, None], span, len(ids))].astype(np.int64)
                    keys_ = which[q][:, None] * (v + 1) + np.where(word < 0, v, word)
                    held = (member[np.minimum(np.searchsorted(member, keys_), len(member) - 1)] == keys_).sum(axis=1)
                    for j in np.flatnonzero(held >= need[q]).tolist():
                        item = own[q[j]]
                        found = confirm(ids, from_[j], to[j], (bounds[d[j]], bounds[d[j] + 1]), item, patterns[q[j]], answers[q[j]])
                        if found and found > best.get((int(d[j]), item.item_id), (0.0, 0.0)):
                            best[int(d[j]), item.item_id] = found

                for low in range(0, len(heavy), 2048):
                    at = heavy[low : low + 2048]
                    window = sums[k][at]
                    norm = np.maximum(np.linalg.norm(window, axis=1), 1e-12)
                    hit = (window @ queries.T) >= (LEAST_COSINE * norm)[:, None]
                    r, q = np.nonzero(hit)
                    keep = weight[at[r]] >= LEAST_MASS * masses[q]
                    r, q = r[keep], q[keep]
                    for j in range(0, len(r), JUDGED):
                        judge(at[r[j : j + JUDGED]], q[j : j + JUDGED])
                # The same grid by rare words; all the windows of an item are met in one turn, so their hits are whole.
                amount = np.cumsum(postings.count[key_word])
                ends = np.searchsorted(key_item, np.arange(len(own)), "right")
                low = 0
                while low < len(key_word):
                    done = int(amount[low - 1]) if low else 0
                    high = int(ends[max(key_item[low], np.searchsorted(amount[np.maximum(ends - 1, 0)], done + LOOKUPS, "right") - 1)])
                    pair, place = postings.places(key_word[low:high])
                    q = key_item[low:high][pair]
                    d = np.searchsorted(bounds, place, "right") - 1
                    inner = place - bounds[d]
                    m0 = np.maximum(0, -(-(inner - scale - edge + 1) // (STRIDE * step)))
                    m1 = np.minimum((inner + edge) // STRIDE, real[d] - 1) // step
                    n = np.maximum(0, m1 - m0 + 1)
                    w = first[np.repeat(d, n)] + step * (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(m0, n))
                    key, times = np.unique(w * len(own) + np.repeat(q, n), return_counts=True)
                    key = key[times >= hits[key % len(own)]]
                    for j in range(0, len(key), JUDGED):
                        judge(key[j : j + JUDGED] // len(own), key[j : j + JUDGED] % len(own))
                    low = high
                for item in own:
                    if len(item.words) < SHORT:
                        for d in runs_of(item.words, ids, bounds, postings).tolist():
                            best[d, item.item_id] = (1.0, 1.0)
            rows = sorted(best.items())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array([k[0] for k, _ in rows], pa.int64())),
                    pa.array([k[1] for k, _ in rows], pa.int64()),
                    pa.array([x[0] for _, x in rows], pa.float64()),
                    pa.array([x[1] for _, x in rows], pa.float64()),
                ],
                names=["doc_id", "item_id", "lcs_share", "answer_share"],
            )

    return coded.mapInArrow(run, f"doc_id {coded.schema['doc_id'].dataType.simpleString()}, {FOUND}")


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str | None]]]:
    """The items in blocks of ITEMS, one block on the driver at a time."""
    rows: list[tuple[int, str | None]] = []
    for r in benchmark.orderBy("item_id", "text").toLocalIterator():
        if r.item_id is not None:
            rows.append((r.item_id, r.text))
        if len(rows) == ITEMS:
            yield rows
            rows = []
    if rows:
        yield rows


def _leaks(docs: DataFrame, benchmark: DataFrame, item_col: str) -> DataFrame:
    """doc_id, item_id, lcs_share, answer_share for ``docs`` (doc_id of any type, text)."""
    found = docs.sparkSession.createDataFrame([], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {FOUND}")
    for rows in _blocks(columns(benchmark, item_id=(item_col, "long"), text=("text", "string"))):
        bench = Benchmark(rows)
        if not bench.items:
            continue
        v, kind = len(bench.vocabulary), np.int16 if len(bench.vocabulary) < 32_000 else np.int32
        coded = materialize(encode(docs, bench.vocabulary), "coded")
        df, passages = frequencies(coded, v, kind)
        idf = np.log((passages + 1) / (df + 1)) + 0.1
        trim()
        hits = materialize(_search(coded, bench, idf, latent_terms(coded, idf, kind), kind), "leaks")
        discard(coded)
        found = found.unionByName(hits)
    return found.groupBy("doc_id", "item_id").agg(F.max(F.struct("lcs_share", "answer_share")).alias("x")).select("doc_id", "item_id", "x.lcs_share", "x.answer_share")


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """doc_id, item_id, lcs_share, answer_share: the benchmark items that each document holds."""
    return _leaks(columns(docs, doc_id=(id_col, "long"), text=(text_col, "string")), benchmark, item_col)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item. Rows are told by their text's digest, so ids don't matter."""
    text = F.col(f"`{text_col}`").cast("string")
    key = F.unhex(F.md5(text.cast("binary")))
    bad = _leaks(docs.select(key.alias("doc_id"), text.alias("text")), benchmark, item_col).select(F.col("doc_id").alias("key")).distinct()
    # A table of its own: both sides of the join are then dealt by it, and a hot text can be split.
    return unpacked(packed(docs, key=key).join(materialize(bad, "leaking").hint("merge"), "key", "left_anti"), docs.columns)

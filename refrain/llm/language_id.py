"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is the average of the embeddings of its subwords (byte runs of two to four inside
words with marked ends, hashed into ``BUCKETS`` rows); a linear layer and a softmax give
probabilities. Both layers are trained together by stochastic gradient descent in numpy,
on the driver, from a bounded sample: at most ``sample`` labelled rows (chosen by a hash of
doc_id; of rows that share one, the least text). Their whole texts count: a bag holds each
subword once, with its share of the text, and the embeddings are averaged by these shares.

A part of the sample is left out of training. On it a temperature is fitted, so that the
score is a calibrated probability, and a rejection threshold: the least score at which
the accepted predictions reach ``precision``.

For prediction embeddings and softmax weights collapse into one table of a score per
bucket and language, so a whole text costs one look-up per subword of its distinct words.

Defined results: a null text, or one without a letter, is ``und`` with score 0, rejected;
rows whose language or doc_id is null don't train; without a training row all is ``und``; repeated
rows each get a result; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import trim
from .tokenization import slices

BUCKETS = 1 << 16
ORDERS = (2, 3, 4)
DIM = 16
LETTER = r"\p{L}"


def _word_grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every subword of the words, and the word it is from."""
    flat = np.frombuffer(b"".join(b"<" + w + b">" for w in words), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    grams, owners = [], []
    for n in ORDERS:
        if len(flat) < n:
            continue
        h = np.full(len(flat) - n + 1, 1469598103934665603 + n, np.uint64)
        for k in range(n):
            h = (h ^ flat[k : len(flat) - n + 1 + k]) * np.uint64(1099511628211)
        inside = owner[: len(h)] == owner[n - 1 :]
        grams.append(((h ^ (h >> np.uint64(29))) % np.uint64(BUCKETS))[inside].astype(np.int64))
        owners.append(owner[: len(h)][inside])
    if not grams:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(grams), np.concatenate(owners)


def _words(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words with a letter, and (text, word) for each place where one stands."""
    parts = pc.ascii_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = parts.flatten().dictionary_encode()
    lettered = pc.match_substring_regex(coded.dictionary, LETTER).to_numpy(zero_copy_only=False)
    index, owner = coded.indices.to_numpy(zero_copy_only=False), np.repeat(np.arange(len(counts)), counts)
    new = np.cumsum(lettered) - 1
    keep = lettered[index] if len(lettered) else np.zeros(len(index), bool)
    words = [w.encode() for w in coded.dictionary.filter(pa.array(lettered)).to_pylist()]
    return words, owner[keep], new[index[keep]] if len(lettered) else index[keep]


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    least_score: float

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        n, k = len(texts), len(self.languages)
        words, owner, word = _words(texts)
        if not words or not k:
            return ["und"] * n, np.zeros(n)
        grams, of = _word_grams(words)
        weight = np.column_stack([np.bincount(of, self.table[grams, c], len(words)) for c in range(k)])
        size = np.bincount(of, minlength=len(words)).astype(float)
        total = np.column_stack([np.bincount(owner, weight[word, c], n) for c in range(k)])
        count = np.bincount(owner, size[word], n)
        logits = (total / np.maximum(count, 1)[:, None] + self.bias) / self.temperature
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        score = np.where(count > 0, p[np.arange(n), best], 0.0)
        return [self.languages[b] if c else "und" for b, c in zip(best.tolist(), count.tolist(), strict=True)], score


class Bags:
    """Rows as runs of (bucket, share of the text)."""

    def __init__(self, size: np.ndarray, bucket: np.ndarray, share: np.ndarray):
        self.size, self.bucket, self.share = size, bucket, share
        self.first = np.cumsum(size) - size

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of some (not empty) rows: sizes, starts, buckets and shares."""
        size = self.size[rows]
        starts = np.cumsum(size) - size
        at = np.arange(int(size.sum())) + np.repeat(self.first[rows] - starts, size)
        return size, starts, self.bucket[at].astype(np.int64), self.share[at]


def fit(bags: Bags, langs: list[str], precision: float = 0.99, epochs: int = 4, seed: int = 5) -> Model:
    """Train on subword bags (one a row, any order that is the same each time)."""
    languages = sorted(set(langs))
    k = len(languages)
    if not k:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 1.0)
    y = np.array([languages.index(v) for v in langs])
    rng = np.random.default_rng(seed)
    held = np.arange(len(y)) % 5 == 4
    e = (rng.random((BUCKETS, DIM), np.float32) - 0.5) / DIM
    w, b = np.zeros((DIM, k), np.float32), np.zeros(k, np.float32)
    used = np.flatnonzero(~held & (bags.size > 0))
    steps, total = 0, max(1, epochs * -(-len(used) // 32))
    for _ in range(epochs):
        order = rng.permutation(used)
        for low in range(0, len(order), 32):
            rows = order[low : low + 32]
            rate, steps = np.float32(0.8 * (1 - steps / total) + 0.01), steps + 1
            size, starts, flat, share = bags.take(rows)
            mean = np.add.reduceat(e[flat] * share[:, None], starts, axis=0)
            z = mean @ w + b
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            back = np.repeat(p @ w.T, size, axis=0) * share[:, None]
            w -= rate * (mean.T @ p) / len(rows) * 4
            b -= rate * p.mean(axis=0)
            np.add.at(e, flat, (-rate * 20 * back).astype(np.float32))
    table = e @ w
    model = Model(languages, table, b.astype(float), 1.0, 0.0)
    rows = np.flatnonzero(held & (bags.size > 0))
    if len(rows):
        _, starts, flat, share = bags.take(rows)
        z = np.column_stack([np.add.reduceat(table[flat, c] * share, starts) for c in range(k)]) + b
        grid = np.geomspace(0.05, 20, 60)

        def loss(t: float) -> float:
            s = z / t
            s = s - s.max(axis=1, keepdims=True)
            return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(rows)), y[rows]]).mean())

        model.temperature = float(min(grid, key=loss))
        s = np.exp((z - z.max(axis=1, keepdims=True)) / model.temperature)
        p = s / s.sum(axis=1, keepdims=True)
        score, right = p.max(axis=1), p.argmax(axis=1) == y[rows]
        down = np.argsort(-score, kind="stable")
        good = np.flatnonzero(np.cumsum(right[down]) >= precision * np.arange(1, len(rows) + 1))
        model.least_score = float(score[down[good[-1]]]) if len(good) else 1.0
    return model


def train(docs: DataFrame, may_train: Column, sample: int = 6_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on at most ``sample`` rows for which ``may_train`` holds and whose language is known."""
    rows = docs.filter(may_train & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    # The ids with the smallest hashes: their bound is found from ids alone, then each scan task keeps its share.
    key = F.xxhash64(F.col("doc"), F.lit(11))
    bound = rows.select(key.alias("h")).distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if bound is None:
        return fit(Bags(*(np.empty(0, np.int64) for _ in range(3))), [])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            words, owner, word = _words(batch.column(1))
            grams, of = _word_grams(words)
            per_word = np.bincount(of, minlength=len(words))
            order = np.argsort(of, kind="stable")
            first = np.cumsum(per_word) - per_word
            bags, shares = [], []
            ends = np.searchsorted(owner, np.arange(batch.num_rows), "right").tolist()
            for low, high in zip([0, *ends[:-1]], ends, strict=True):
                seen, times = np.unique(word[low:high], return_counts=True)
                n = per_word[seen]
                at = np.arange(int(n.sum())) + np.repeat(first[seen] - (np.cumsum(n) - n), n)
                count = np.bincount(grams[order[at]], np.repeat(times, n), BUCKETS)
                bucket = np.flatnonzero(count)
                bags.append(bucket.astype(np.uint16))
                shares.append((count[bucket] / max(1.0, count.sum())).astype(np.float32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([x.tobytes() for x in bags], pa.binary()), pa.array([x.tobytes() for x in shares], pa.binary())], names=["doc", "lang", "bag", "share"])

    # One row an id, however many rows share it; then a bag holds at most BUCKETS subwords of six bytes.
    single = rows.filter(key <= bound).groupBy("doc").agg(F.min(F.struct("text", "lang")).alias("x")).select("doc", "x.text", "x.lang")
    got = single.mapInArrow(draw, "doc long, lang string, bag binary, share binary").toArrow().combine_chunks().sort_by("doc")
    bag, share = (got[c].combine_chunks() if got.num_rows else pa.array([], pa.binary()) for c in ("bag", "share"))
    size = pc.binary_length(bag).to_numpy(zero_copy_only=False).astype(np.int64) // 2
    bags = Bags(size, np.frombuffer(b"".join(bag.to_pylist()), np.uint16), np.frombuffer(b"".join(share.to_pylist()), np.float32))
    langs = got["lang"].to_pylist()
    del got, bag, share
    model = fit(bags, langs)
    del bags
    trim()
    return model


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, rejected for each row."""
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            langs, score = model.predict(batch.column(1))
            rejected = (score < model.least_score) | (np.array(langs) == "und")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")

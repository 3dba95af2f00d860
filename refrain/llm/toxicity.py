"""Toxicity by a classifier chain of linear models.

Categories are binary columns of labelled rows, in a fixed order. The chain predicts them
one after the other: the model of a category sees the text's features and the
probabilities of the categories before it. While it is trained those probabilities are
out-of-fold predictions, so a later model learns from inputs as uncertain as it will meet.

Features are the distinct words of the whole text, and the first four and five letters of
longer words, which catch inflected and disguised forms. For each model the most telling
ones (chi-squared, in the rows it is trained on) are used; each model is an L2-regularised
logistic regression. The chain is fitted on the driver from a bounded sample of labelled
rows (``sample`` rows, chosen by a hash of doc_id); everything else covers all rows. The
features of those rows are counted and ranked in Spark, and only the chosen ones (at most
``FEATURES`` a model, of at least four sampled rows) come to the driver. The rejection threshold is the one with the best F1 over the out-of-fold predictions.

Defined results: a null or wordless text has no features and gets the categories' base
rates; a label that is null leaves its row out of that category; several labels of one
doc_id count as their maximum; rows of the sample that share a doc_id train as one, by the
least of their texts; without any labelled row all probabilities are 0; repeated
rows each get a result; an empty table gives an empty result. Other columns are passed on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, trim
from .tokenization import slices

FOLDS = 5
FEATURES = 800
#: Least chi-squared statistic of a feature: with a million candidates, fewer than one passes by chance.
LEAST_CHI = 25
MARKS = " \t\n\r\x0b\x0c.,;:!?\"'()[]{}<>|*#$%&-_=+~`^/\\"


def word_features(word: str) -> list[int]:
    """The features that one word of a text gives, as 64-bit hashes."""
    word = word.strip(MARKS)
    if not word:
        return []
    names = [f"w{word}"] + [f"{k}{word[:k]}" for k in (4, 5) if len(word) > k]
    return [xxhash.xxh3_64_intdigest(x.encode()) - (1 << 63) for x in names]


def _distinct_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words of a batch, and (text, word) pairs."""
    parts = pc.ascii_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = parts.flatten().dictionary_encode()
    return coded.dictionary.to_pylist(), np.repeat(np.arange(len(counts)), counts), coded.indices.to_numpy(zero_copy_only=False)


@dataclass
class Linear:
    """Weights by feature, one weight per earlier category, and a bias."""

    weights: dict[int, float] = field(default_factory=dict)
    earlier: list[float] = field(default_factory=list)
    bias: float = -50.0

    def score(self, own: np.ndarray, before: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(own + self.bias + before @ np.array(self.earlier, float).reshape(-1), -50, 50)))


@dataclass
class Chain:
    categories: list[str]
    models: list[Linear]
    thresholds: list[float]

    def predict(self, batch: pa.Array, memo: dict[str, tuple[int, ...]], columns: dict[int, int], weights: np.ndarray) -> np.ndarray:
        """Probabilities (text, category). ``columns`` and ``weights`` are :meth:`table`'s."""
        words, owner, index = _distinct_words(batch)
        hit = np.zeros(len(words), bool)
        features: list[tuple[int, ...]] = []
        for i, w in enumerate(words):
            got = memo.get(w)
            if got is None:
                got = tuple(columns[f] for f in word_features(w) if f in columns)
                if len(memo) < 300_000:
                    memo[w] = got
            features.append(got)
            hit[i] = bool(got)
        own = np.zeros((len(batch), len(self.models)))
        at = np.flatnonzero(hit[index]) if len(words) else np.empty(0, np.int64)
        pairs = {(int(owner[k]), f) for k in at.tolist() for f in features[index[k]]}
        for text, f in pairs:
            own[text] += weights[f]
        out = np.zeros_like(own)
        for c, model in enumerate(self.models):
            out[:, c] = model.score(own[:, c], out[:, :c])
        return out

    def table(self) -> tuple[dict[int, int], np.ndarray]:
        names = sorted({f for m in self.models for f in m.weights})
        weights = np.array([[m.weights.get(f, 0.0) for m in self.models] for f in names]).reshape(len(names), len(self.models))
        return {f: i for i, f in enumerate(names)}, weights


def _logistic(x: np.ndarray, y: np.ndarray, l2: float, steps: int = 300) -> np.ndarray:
    """Weights of [x, 1] by accelerated full-batch gradient descent.

    Each coordinate's step is the inverse of a bound on its curvature (inputs are not
    negative), so rare features move as fast as common ones.
    """
    n, d = x.shape
    reach = x.sum(axis=1) + 1
    step = 1 / np.append(0.25 * (x.T @ reach) / n + l2 / n, 0.25 * reach.mean()).astype(np.float32)
    w = np.zeros(d + 1, np.float32)
    rate = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    w[-1] = np.log(rate / (1 - rate))
    last = w.copy()
    for t in range(steps):
        v = w + (t / (t + 3)) * (w - last)
        g = 1 / (1 + np.exp(-np.clip(x @ v[:-1] + v[-1], -30, 30))) - y
        grad = np.append(x.T @ g, g.sum()).astype(np.float32) / n
        grad[:-1] += l2 / n * v[:-1]
        w, last = v - step * grad, w
    return w


@dataclass
class Sample:
    """The labelled rows on the driver: their folds, and which of the chosen features (by number) each row has."""

    names: np.ndarray
    fold: np.ndarray
    row: np.ndarray
    feature: np.ndarray
    #: (category, fold left out, or FOLDS for none) -> the numbers of the features to train on.
    chosen: dict[tuple[str, int], np.ndarray]

    def matrix(self, rows: np.ndarray, features: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        """One column per feature, then the earlier categories' probabilities."""
        place, column = np.full(len(self.fold), -1), np.full(len(self.names), -1)
        place[rows], column[features] = np.arange(len(rows)), np.arange(len(features))
        r, c = place[self.row], column[self.feature]
        inside = (r >= 0) & (c >= 0)
        x = np.zeros((len(rows), len(features) + earlier.shape[1]), np.float32)
        x[:, len(features) :] = earlier[rows]
        x[r[inside], c[inside]] = 1
        return x


def _best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    k = int(f1.argmax())
    below = p[order[k + 1]] if k + 1 < len(y) else 0.0
    return float((p[order[k]] + below) / 2)


def fit_chain(store: Sample, labels: dict[str, np.ndarray], l2: float = 0.03) -> Chain:
    """``labels``: category -> 0, 1 or NaN for each row of the sample, in chain order."""
    n = len(store.fold)
    chain, earlier = Chain([], [], []), np.zeros((n, 0))
    none = np.empty(0, np.int64)
    for category, y in labels.items():
        out = np.zeros(n)
        rows = np.flatnonzero(~np.isnan(y))
        if len(rows) and 0 < y[rows].sum() < len(rows):
            for k in range(FOLDS):
                inside, outside = rows[store.fold[rows] != k], np.flatnonzero(store.fold == k)
                if not len(inside):
                    continue
                picked = store.chosen.get((category, k), none)
                w = _logistic(store.matrix(inside, picked, earlier), y[inside].astype(np.float32), l2)
                out[outside] = 1 / (1 + np.exp(-np.clip(store.matrix(outside, picked, earlier) @ w[:-1] + w[-1], -50, 50)))
            picked = store.chosen.get((category, FOLDS), none)
            w = _logistic(store.matrix(rows, picked, earlier), y[rows].astype(np.float32), l2)
            m = len(picked)
            model = Linear({int(store.names[f]): float(v) for f, v in zip(picked, w[:m], strict=True)}, [float(v) for v in w[m:-1]], float(w[-1]))
            threshold = _best_threshold(out[rows], y[rows])
        else:
            base = float(y[rows].mean()) if len(rows) else 0.0
            model, threshold = Linear({}, [0.0] * earlier.shape[1], 50.0 if base else -50.0), 0.5
            out[:] = base
        chain.categories.append(category)
        chain.models.append(model)
        chain.thresholds.append(threshold)
        earlier = np.column_stack([earlier, out])
    return chain


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], sample: int = 8_000, id_col: str = "doc_id", text_col: str = "text") -> Chain:
    """Fit the chain on at most ``sample`` labelled rows. ``categories``: name -> boolean expression over ``labels``, in chain order."""
    label = labels.select(F.col(id_col).cast("long").alias("doc"), *[e.cast("int").alias(c) for c, e in categories.items()]).filter("doc is not null")
    label = label.groupBy("doc").agg(*[F.max(c).alias(c) for c in categories])
    picked = label.orderBy(F.xxhash64("doc"), "doc").limit(sample)
    names = list(categories)

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, 2 << 20):
            words, owner, index = _distinct_words(batch.column(1))
            per_word = [word_features(w) for w in words]
            bags: list[set[int]] = [set() for _ in range(batch.num_rows)]
            for text, w in zip(owner.tolist(), index.tolist(), strict=True):
                bags[text].update(per_word[w])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sorted(b) for b in bags], pa.list_(pa.int64())), *batch.columns[2:]], names=["doc", "bag", *names])

    kinds = ", ".join(f"`{c}` int" for c in names)
    joined = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text")).join(F.broadcast(picked), "doc")
    # One text for each id, however many rows share it.
    single = joined.groupBy("doc", *names).agg(F.min("text").alias("text")).select("doc", "text", *names)
    bags = materialize(single.mapInArrow(bag, f"doc long, bag array<long>, {kinds}").withColumn("fold", F.pmod(F.xxhash64("doc", F.lit(17)), F.lit(FOLDS)).cast("int")), "bags")
    rows = bags.select("doc", "fold", *names).toArrow().combine_chunks()
    rows = rows.take(pc.sort_indices(rows["doc"]))
    docs_in, fold = rows["doc"].to_numpy(), rows["fold"].to_numpy()
    labels_in = {c: np.array([np.nan if v is None else v for v in rows[c].to_pylist()], float) for c in names}
    telling = _telling(bags, fold, labels_in).collect()
    numbers = {f: i for i, f in enumerate(sorted({r.f for r in telling}))}
    chosen: dict[tuple[str, int], list[int]] = {}
    for r in telling:
        chosen.setdefault((r.category, r.left_out), []).append(numbers[r.f])
    known = docs.sparkSession.createDataFrame(list(numbers.items()), "f long, i int")
    pairs = bags.select("doc", F.explode("bag").alias("f")).join(F.broadcast(known), "f").select("doc", "i").toArrow()
    sample_rows = Sample(
        np.array(sorted(numbers), np.int64),
        fold,
        np.searchsorted(docs_in, pairs["doc"].to_numpy()).astype(np.int32),
        pairs["i"].to_numpy(),
        {k: np.array(sorted(v), np.int64) for k, v in chosen.items()},
    )
    chain = fit_chain(sample_rows, labels_in)
    del rows, pairs, sample_rows
    discard(bags)
    trim()
    return chain


def _telling(bags: DataFrame, fold: np.ndarray, labels: dict[str, np.ndarray], least: int = 4) -> DataFrame:
    """(category, left_out, f): for each category and training set the FEATURES features with the largest chi-squared statistic, ties by hash.

    A training set is the rows of all folds but ``left_out``. Counts, statistics and ranks stay in Spark;
    what comes out has at most FEATURES rows for each model.
    """
    counts, sets = [], []
    for c, y in labels.items():
        for k in range(FOLDS):
            inside = F.col("fold") == k
            counts += [F.count_if(inside & F.col(f"`{c}`").isNotNull()).alias(f"n_{c}_{k}"), F.count_if(inside & (F.col(f"`{c}`") == 1)).alias(f"a_{c}_{k}")]
        for left_out in range(FOLDS + 1):
            held = (fold != left_out) & ~np.isnan(y)
            if not held.any() or not 0 < y[held].sum() < held.sum():
                continue
            rate = float(y[held].mean())
            n, a = (sum((F.col(f"`{x}_{c}_{k}`") for k in range(FOLDS) if k != left_out), F.lit(0)) for x in "na")
            chi = F.pow(a - n * rate, F.lit(2)) / F.greatest(n * rate * (1 - rate), F.lit(1e-9))
            sets.append(F.struct(F.lit(c).alias("category"), F.lit(left_out).alias("left_out"), F.when(n >= least, chi).otherwise(0.0).alias("chi")))
    pairs = bags.select("fold", *[F.col(f"`{c}`") for c in labels], F.explode("bag").alias("f"))
    if not sets:
        return pairs.limit(0).select(F.lit("").alias("category"), F.lit(0).alias("left_out"), "f")
    found = pairs.groupBy("f").agg(*counts).select("f", F.explode(F.filter(F.array(*sets), lambda s: s["chi"] > LEAST_CHI)).alias("s")).select("f", "s.*")
    order = Window.partitionBy("category", "left_out").orderBy(F.desc("chi"), "f")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= FEATURES).select("category", "left_out", "f")


def score(docs: DataFrame, chain: Chain, reject: str, text_col: str = "text") -> DataFrame:
    """``docs`` with p_<category> for each category and ``rejected``: category ``reject`` at or over its threshold."""
    names, weights = chain.table()
    r = chain.categories.index(reject)
    made = [f"p_{c}" for c in chain.categories] + ["rejected"]
    kept = [c for c in docs.columns if c not in made]
    docs = docs.select(*[F.col(f"`{c}`") for c in kept])
    at = kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for batch in slices(batches, at):
            p = chain.predict(batch.column(at), memo, names, weights)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(p[:, c]) for c in range(p.shape[1])], pa.array(p[:, r] >= chain.thresholds[r])], names=[*kept, *made])
        memo.clear()
        trim()

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + [f"`{m}` double" for m in made[:-1]] + ["rejected boolean"])
    return docs.mapInArrow(run, schema)


def label_categories() -> dict[str, Column]:
    """The chain over the ``labels`` table: low quality, then toxicity, then the two together."""
    return {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1, "toxic_low_quality": (F.col("toxic") == 1) & (F.col("quality") == 0)}

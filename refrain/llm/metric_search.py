"""Exact top-k inner-product search with M-trees.

Components become integers, floor(64 x). To make the largest inner product the nearest
neighbour of a metric, every vector gets one more component that brings it to the largest
norm M in the table; queries get a zero there. Then |q - x|^2 = |q|^2 + M^2 - 2 q.x.

Vectors are dealt at random into shards of bounded size, so a cluster or a third of equal
vectors spreads evenly, and each shard gets an M-tree: paged nodes whose entries have a
routing object, a covering radius and the distance to the parent's routing object. Trees
are written to the shared folder.

Queries go in blocks to every shard. A search is best-first: a heap of nodes by their lower
bound; an entry whose stored distances already put it beyond the k-th best (triangle
inequality) is dropped without computing its distance. Leaf entries that are left get their
integer inner product. Bounds are floats, so they are used with a slack, and equal scores
are never pruned; the result is exact. A tree is sent once to every ``QUERY_BLOCK`` queries,
with components of two or four bytes where the norms allow it.

Defined results: vectors that are null or hold a null or non-finite component, and rows
with a null id, take no part; vectors of several lengths are padded with zeros; a row that
repeats an id is a candidate of its own, and no candidate for queries of that id; ties go
to the smaller id; with fewer candidates than k all are returned; an empty table gives an
empty result; components and scores beyond 64 bits are the nearest 64-bit number. Other
columns are ignored.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SHARD_ROWS = 8192
PAGE, FANOUT = 1024, 16
QUERY_BLOCK = 4096
#: Of bounds, absolute and in parts of the norms: what rounding can take from a root of a difference of squares.
SLACK = 1e-6
LONG = (-(1 << 63), (1 << 63) - 1)


@dataclass
class Tree:
    """Nodes as parallel arrays. A node's rows or child nodes are the run [low, high)."""

    routing: np.ndarray
    radius: np.ndarray
    to_parent: np.ndarray
    leaf: np.ndarray
    low: np.ndarray
    high: np.ndarray
    #: Leaf entries in page order: their place in the input, and the distance to their page's routing object.
    rows: np.ndarray
    row_distance: np.ndarray

    def pack(self) -> list[bytes]:
        kinds = (np.float64, np.float64, np.float64, np.bool_, np.int64, np.int64, np.int64, np.float64)
        return [np.ascontiguousarray(a, k).tobytes() for a, k in zip(vars(self).values(), kinds, strict=True)]

    @classmethod
    def unpack(cls, parts: list[bytes], width: int) -> Tree:
        kinds = (np.float64, np.float64, np.float64, np.bool_, np.int64, np.int64, np.int64, np.float64)
        arrays = [np.frombuffer(p, k) for p, k in zip(parts, kinds, strict=True)]
        return cls(arrays[0].reshape(-1, width), *arrays[1:])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((a - b) ** 2).sum(axis=-1), 0))


def build(points: np.ndarray, seed: int = 1) -> Tree:
    """Bulk-load an M-tree, level by level from the root."""
    rng = np.random.default_rng(seed)
    center = points[int(rng.integers(len(points)))]
    nodes: list[list] = [[center, float(_distances(points, center).max()), 0.0, None, np.arange(len(points))]]
    rows, distances = [], []
    filled = at = 0
    while at < len(nodes):
        center, _, _, _, members = nodes[at]
        own = points[members]
        parts: list[np.ndarray] = []
        if len(members) > PAGE:
            k = min(FANOUT, -(-len(members) // PAGE) * 2)
            pivots = own[rng.choice(len(members), k, replace=False)]
            table = (own**2).sum(axis=1)[:, None] - 2 * own @ pivots.T + (pivots**2).sum(axis=1)
            nearest = table.argmin(axis=1)
            parts = [np.flatnonzero(nearest == j) for j in range(k)]
            parts = [p for p in parts if len(p)]
            if len(parts) == 1:  # equal points: cut by position
                parts = np.array_split(np.arange(len(members)), k)
        if parts:
            nodes[at][3] = (False, len(nodes), len(nodes) + len(parts))
            for p in parts:
                inner = points[members[p]]
                mean = inner.mean(axis=0)
                pivot = inner[int(_distances(inner, mean).argmin())]
                nodes.append([pivot, float(_distances(inner, pivot).max()), float(_distances(pivot, center)), None, members[p]])
        else:
            d = _distances(own, center)
            order = np.argsort(d, kind="stable")
            rows.append(members[order])
            distances.append(d[order])
            nodes[at][3] = (True, filled, filled + len(members))
            filled += len(members)
        at += 1
    return Tree(
        np.array([n[0] for n in nodes]),
        np.array([n[1] for n in nodes]),
        np.array([n[2] for n in nodes]),
        np.array([n[3][0] for n in nodes]),
        np.array([n[3][1] for n in nodes]),
        np.array([n[3][2] for n in nodes]),
        np.concatenate(rows),
        np.concatenate(distances),
    )


def arithmetic(norm2: float) -> type:
    """A type in which all inner products are exact: no partial sum exceeds the product of two norms."""
    return np.float32 if norm2 < 1 << 24 else np.float64 if norm2 < 1 << 52 else np.int64 if norm2 < 1 << 62 else object


def storage(norm2: float) -> type:
    """A type that holds all components."""
    return np.int16 if norm2 < 1 << 30 else np.int32 if norm2 < 1 << 62 else np.int64


def search(tree: Tree, vectors: np.ndarray, ids: np.ndarray, query: np.ndarray, query_id: int, k: int, norm2: float) -> tuple[list[tuple[int, int]], int]:
    """The k best (score, id), best first, and how many inner products it took. ``vectors``, ``ids``: in page order."""
    point = np.append(query, 0).astype(float)
    base = float(query.astype(float) @ query.astype(float)) + norm2
    slack = SLACK * (1 + float(np.sqrt(base)))
    heap = [(0.0, 0, float(_distances(tree.routing[0], point)))]
    scores, found = np.empty(0, np.int64), np.empty(0, np.int64)
    tau, least, work = np.inf, 0, 0
    while heap:
        bound, node, to_node = heapq.heappop(heap)
        if bound > tau:
            break
        low, high = int(tree.low[node]), int(tree.high[node])
        if tree.leaf[node]:
            # Entries are sorted by their distance to the page's routing object: the bound keeps a run of them.
            d = tree.row_distance[low:high]
            a, b = np.searchsorted(d, [to_node - tau, np.nextafter(to_node + tau, np.inf)]) if tau < np.inf else (0, len(d))
            own = slice(low + int(a), low + int(b))
            s = vectors[own] @ query
            if s.dtype == object:
                s = np.array([min(max(x, LONG[0]), LONG[1]) for x in s], np.int64)
            work += len(s)
            # Few entries reach the k-th best so far; only they are merged.
            rows = np.flatnonzero(s >= least) if len(scores) == k else np.arange(len(s))
            # The query's own rows go first, however many: they would take the places of others.
            rows = rows[ids[low + int(a) + rows] != query_id]
            if len(rows) > 4 * k:
                rows = rows[s[rows] >= np.partition(s[rows], -k)[-k]]
            scores, found = np.append(scores, s[rows].astype(np.int64)), np.append(found, ids[low + int(a) + rows])
            if len(scores) > k:
                order = np.lexsort((found, -scores))[:k]
                scores, found = scores[order], found[order]
            if len(scores) == k:
                least = int(scores.min())
                tau = float(np.sqrt(max(base - 2 * least, 0))) + slack
            continue
        kids = np.arange(low, high)
        far = np.abs(to_node - tree.to_parent[low:high]) - tree.radius[low:high]
        kids = kids[far <= tau]
        d = _distances(tree.routing[kids], point)
        for c, x, r in zip(kids.tolist(), d.tolist(), tree.radius[kids].tolist(), strict=True):
            if x - r <= tau:
                heapq.heappush(heap, (max(0.0, x - r), c, x))
    order = np.lexsort((found, -scores))[:k]
    return list(zip(scores[order].tolist(), found[order].tolist(), strict=True)), work


def integer_components(vector: Column) -> Column:
    """floor(64 x) of each component, or null for a vector that takes no part."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    good = F.forall(doubles, lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    return F.when(vector.isNotNull() & good, F.transform(doubles, lambda x: F.floor(F.lit(64.0) * x).cast("long")))


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` largest integer inner products of each row for which ``is_query`` holds."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("query"), integer_components(F.col(f"`{vector_col}`")).alias("v"))
    rows = materialize(rows.filter(F.col("v").isNotNull() & F.col("vec_id").isNotNull()), "vectors")
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    n, norm2, width = rows.agg(F.count("*"), F.max(norm), F.max(F.size("v"))).first()
    result = "query_id long, rank int, vec_id long, score long"
    if not n:
        return spark.createDataFrame([], result)
    shards = -(-n // SHARD_ROWS)

    def matrix(column: pd.Series) -> np.ndarray:
        if all(len(x) == width for x in column):
            return np.stack(column.to_numpy())
        out = np.zeros((len(column), width), np.int64)
        for i, x in enumerate(column):
            out[i, : len(x)] = x
        return out

    fields = list(Tree.__dataclass_fields__)

    def plant(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vec_id", kind="stable", ignore_index=True)
        own = matrix(group["v"])
        points = own.astype(float)
        points = np.column_stack([points, np.sqrt(np.maximum(norm2 - (points**2).sum(axis=1), 0))])
        tree = build(points)
        made = dict(zip(fields, ([p] for p in tree.pack()), strict=True))
        return pd.DataFrame({"shard": [key[0]], "ids": [group["vec_id"].to_numpy(np.int64)[tree.rows].tobytes()], "v": [own[tree.rows].astype(storage(norm2)).tobytes()], **made})

    schema = ", ".join(["shard int, ids binary, v binary", *[f"{f} binary" for f in fields]])
    dealt = rows.select("vec_id", "v", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(shards)).cast("int").alias("shard"))
    trees = materialize(dealt.groupBy("shard").applyInPandas(plant, schema), "trees")
    queries = rows.filter("query").select(F.col("vec_id").alias("query_id"), "v").dropDuplicates(["query_id"])
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    asked = queries.select("query_id", F.col("v").cast(f"array<{np.dtype(storage(norm2)).itemsize == 8 and 'long' or 'int'}>").alias("v"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    offered = trees.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def answer(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int]] = []
        if len(left) and len(right):
            held = right.iloc[0]
            tree = Tree.unpack([held[f] for f in fields], width + 1)
            ids, own = np.frombuffer(held["ids"], np.int64), np.frombuffer(held["v"], storage(norm2)).reshape(-1, width)
            exact = own.astype(arithmetic(norm2))
            for query_id, q in zip(left["query_id"].tolist(), matrix(left["v"]), strict=True):
                best, _ = search(tree, exact, ids, q.astype(exact.dtype), query_id, k, norm2)
                out += [(query_id, vec_id, int(score)) for score, vec_id in best]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"], dtype="int64")

    partial = asked.groupBy("shard", "block").cogroup(offered.groupBy("shard", "block")).applyInPandas(answer, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return partial.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

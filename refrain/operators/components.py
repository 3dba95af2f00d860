"""Connected components of an edge table, without collecting it.

Each task first reduces its own edges to stars of a local forest, which shortens chains.
Labels start as node ids. A round takes each node's smallest label among its neighbours
(a join and a map-side combined minimum), then the label of its label. Each round's
labels go to the shared folder, so the plan doesn't grow and a lost executor costs a
re-read. Rounds end when the sum of labels stays: labels only fall.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, materialize

#: Edges that a task joins at a time.
LOCAL_EDGES = 1 << 18


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, root) of a spanning forest of the task's edges, LOCAL_EDGES at a time."""
    parent: dict[int, int] = {}
    held = 0

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    def made() -> pa.RecordBatch:
        rows = [(x, root(x)) for x in list(parent)]
        rows = [(x, r) for x, r in rows if x != r]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int64()), pa.array([r for _, r in rows], pa.int64())], names=["u", "v"])

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
        held += batch.num_rows
        if held >= LOCAL_EDGES:
            yield made()
            parent.clear()
            held = 0
    yield made()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``links``: the smallest id that it reaches. Nulls and loops link nothing."""
    pairs = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).filter("u <> v").mapInArrow(_stars, "u long, v long")
    edges = materialize(pairs.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*"), "edges")
    # The first round needs no join: the smallest neighbour's label is its id.
    labels = materialize(edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")), "labels")
    before = None
    while True:
        seen = labels.select(F.col("node").alias("v"), F.col("label").alias("l"))
        offers = edges.join(seen.hint("merge"), "v").groupBy("u").agg(F.min("l").alias("offer"))
        hooked = labels.join(offers.hint("merge"), labels.node == offers.u).select("node", F.least("label", "offer").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        after = materialize(hooked.join(jump.hint("merge"), "label", "left").select("node", F.least("label", "next").alias("component")), "labels")
        total = after.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]
        discard(labels)
        if total == before or total is None:
            discard(edges)
            return after
        labels, before = after.withColumnRenamed("component", "label"), total

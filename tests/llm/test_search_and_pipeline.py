import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from refrain.llm import metric_search as ms
from refrain.llm import queries as q

from ..oracle import same

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    same(q.queries()[name], q.oracle_sql()[name], spark, DATA)


def brute(vectors, ids, query, query_id, k):
    rows = sorted((-int(v @ query), int(i)) for v, i in zip(vectors, ids, strict=True) if i != query_id)[:k]
    return [(-s, i) for s, i in rows]


@pytest.mark.parametrize("kind", ["clusters", "equal", "ties"])
def test_tree_search_is_exact_and_prunes(kind, monkeypatch):
    monkeypatch.setattr(ms, "PAGE", 32)
    rng = np.random.default_rng(1)
    if kind == "clusters":
        v = np.repeat(rng.integers(-300, 300, (20, 8)), 60, axis=0) + rng.integers(-3, 4, (1200, 8))
    else:
        v = rng.integers(-1, 2, (1200, 8)) if kind == "ties" else np.full((1200, 8), 3)
    ids = rng.permutation(1200)
    norm2 = int((v**2).sum(axis=1).max())
    tree = ms.build(np.column_stack([v, np.sqrt(norm2 - (v**2).sum(axis=1))]).astype(float))
    assert sorted(tree.rows.tolist()) == list(range(1200))
    again = ms.Tree.unpack(tree.pack(), 9)
    done = 0
    for at in range(0, 1200, 40):
        got, work = ms.search(again, v[tree.rows].astype(float), ids[tree.rows], v[at].astype(float), int(ids[at]), 20, norm2)
        assert got == brute(v, ids, v[at], ids[at], 20)
        done += work
    if kind == "clusters":
        assert done < 0.5 * 30 * 1200


def test_radii_cover(monkeypatch):
    monkeypatch.setattr(ms, "PAGE", 16)
    points = np.random.default_rng(2).normal(size=(500, 4))
    tree = ms.build(points)
    for n in np.flatnonzero(tree.leaf):
        d = np.linalg.norm(points[tree.rows[tree.low[n] : tree.high[n]]] - tree.routing[n], axis=1)
        assert d.max() <= tree.radius[n] + 1e-9 and np.allclose(d, tree.row_distance[tree.low[n] : tree.high[n]])


def test_top_k_edge_cases(spark, monkeypatch):
    monkeypatch.setattr(ms, "SHARD_ROWS", 16)
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(60)]
    odd = [(60, None), (80, [1.0, None, 0.0, 0.0]), (100, [float("nan"), 0.0, 0.0, 0.0]), (120, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0, 1.0, 1.0, 1.0])]
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows + odd], "vec_id long, embedding array<float>, label int, score string")
    got = ms.top_k(frame, F.col("vec_id") % 20 == 0, k=7).orderBy("query_id", "rank").collect()
    table = np.array([np.floor(64 * np.array(v, np.float32).astype(float)) for _, v in rows]).astype(int)
    want = [(i, r + 1, v, s) for i in (0, 20, 40) for r, (s, v) in enumerate(brute(table, range(60), table[i], i, 7))]
    assert [tuple(r) for r in got] == want
    assert ms.top_k(frame.limit(0), F.lit(True)).count() == 0
    assert ms.top_k(frame.filter("vec_id in (0, 20)"), F.lit(True), k=7).count() == 2


@pytest.mark.parametrize("copies", [2, 30])
def test_repeated_query_ids_take_no_places(spark, copies):
    rng = np.random.default_rng(4)
    v = rng.integers(-64, 65, (300, 4))
    ids = list(range(300)) + [0] * (copies - 1)
    v = np.vstack([v, np.repeat(v[:1], copies - 1, axis=0)])
    v[np.array(ids) == 0] = 90
    frame = spark.createDataFrame([(i, (x / 64).tolist()) for i, x in zip(ids, v, strict=True)], "vec_id long, embedding array<double>")
    got = ms.top_k(frame, F.col("vec_id") == 0, k=20).orderBy("rank").collect()
    assert [(r.score, r.vec_id) for r in got] == brute(v, ids, v[0], 0, 20)


@pytest.mark.parametrize("size", [1.0, 3e5, 1e9, 1e12])
def test_components_of_any_size(spark, size):
    rng = np.random.default_rng(5)
    v = rng.uniform(-size, size, (120, 3))
    v[60:70] = v[60]  # ties
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] * 3, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in ms.top_k(frame, F.col("vec_id") % 20 == 0, k=5).orderBy("query_id", "rank").collect()]
    table = [[int(np.floor(64 * c)) for c in x] for x in v] * 3
    want = []
    for q in range(0, 120, 20):
        scores = sorted((-min(max(sum(a * b for a, b in zip(table[q], x, strict=True)), ms.LONG[0]), ms.LONG[1]), i % 120) for i, x in enumerate(table) if i % 120 != q)
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:5])]
    assert got == want


def test_pipeline(spark):
    rows = corpus_pipeline.run(spark, DATA).toPandas()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "decontamination", "packing"]
    assert rows.groupby("sequence_id")["length"].sum().max() <= 4096
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    toxic = spark.read.parquet(f"{DATA}/labels.parquet").filter("toxic = 0").select("doc_id")
    clean = {r.doc_id for r in docs.join(toxic, "doc_id").collect()}
    assert len(clean & set(rows["doc_id"])) > 0.85 * len(clean)


def test_line_stage_drops_recurring_short_lines(spark):
    docs = spark.createDataFrame([(i, "Les.\nbody", 9) for i in range(3)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.drop_recurring_lines(spark, docs, DATA).collect()}
    assert got == {0: ("Les.\nbody", 9), 1: ("", 0), 2: ("", 0)}


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), DATA).count() == 0, name

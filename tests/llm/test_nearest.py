"""Operator 12 against brute force over all pairs."""

import numpy as np
import pyarrow.parquet as pq
import pytest

from tessera.llm import hnsw
from tessera.llm.nearest import FOUND, nearest


def brute(rows, k, every):
    """rows: (vec_id, vector). query_id to its list of (vec_id, score), nearest first."""
    rows = sorted({(i, tuple(map(float, v))) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)})
    d = max((len(v) for _, v in rows), default=0)
    x = np.array([list(v) + [0.0] * (d - len(v)) for _, v in rows]).reshape(len(rows), d)
    ids = np.array([i for i, _ in rows])
    out = []
    for q in np.flatnonzero(ids % every == 0):
        score = x @ x[q]
        order = [j for j in np.lexsort((ids, -score)) if j != q][:k]
        out.append((int(ids[q]), [(int(ids[j]), float(score[j])) for j in order]))
    return out


def lists(df):
    got = {}
    for r in sorted(df.collect()):
        got.setdefault(r.query_id, []).append(r)
    assert all([r.rank for r in x] == list(range(1, len(x) + 1)) for x in got.values())
    return {q: [(r.vec_id, r.score) for r in x] for q, x in got.items()}


def recall(got, want):
    return np.mean([len({i for i, _ in got.get(q, [])} & {i for i, _ in x}) / max(1, len(x)) for q, x in want])


def test_small_tables_are_exact(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (40, [-1.0, 2.0]), (60, None), (80, [nan, 1.0]), (100, [inf, 0.0]), (120, [0.0, 0.0]), (140, []), (None, [1.0, 1.0]), (3, [None, 1.0]), (160, [3.0]), (5, [0.0, 0.0, 9.0]), (7, [0.0, 1.0]), (7, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("vec_id", "embedding", "1 AS score", "2 AS rank", "3 AS pid")
    want = dict(brute(rows, 4, 20))
    got = lists(nearest(spark, df, k=4))
    assert {q: [(i, round(s, 9)) for i, s in x] for q, x in got.items()} == {q: [(i, round(s, 9)) for i, s in x] for q, x in want.items()}
    assert len(lists(nearest(spark, df, k=50))[0]) == len({(i, str(v)) for i, v in rows if i in (0, 20, 1, 2, 40, 160, 5, 7)}) - 1
    empty = nearest(spark, df.limit(0))
    assert empty.count() == 0 and empty.dtypes == spark.createDataFrame([], FOUND).dtypes


def test_copies_cost_one_point(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 == 0 else rng.integers(-5, 6, size=3).astype(float).tolist()) for i in range(600)]
    got = lists(nearest(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=20, wide=600))
    for q, x in brute(rows, 20, 20):
        assert [(i, round(s, 9)) for i, s in got[q]] == [(i, round(s, 9)) for i, s in x]


def test_recall_over_shards(spark):
    table = pq.read_table("/root/testdata/sf0.1/embeddings.parquet").to_pydict()
    rows = list(zip(table["vec_id"], table["embedding"], strict=True))
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = brute(rows, 20, 20)
    got = lists(nearest(spark, df, shard_rows=400))
    assert len(got) == len(want) and all(len(x) == 20 for x in got.values())
    assert recall(got, want) >= 0.97


@pytest.mark.parametrize("kind", ["clusters", "lengths", "near copies"])
def test_graph_recall(kind):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 32))
    if kind == "clusters":
        x = np.repeat(rng.normal(size=(40, 32)), 100, axis=0) + 0.05 * x
    elif kind == "lengths":
        x *= rng.lognormal(sigma=1, size=(4000, 1))
    else:
        x[:1500] = x[0] + 1e-3 * x[:1500]
    graph, order = hnsw.Graph.build(x)
    q = x[::40]
    found = graph.search(q, 128)
    want = np.argsort(-(q @ x.T), axis=1)[:, :20]
    assert np.mean([len(set(order[f[f >= 0]]) & set(w)) / 20 for f, w in zip(found, want, strict=True)]) >= 0.9

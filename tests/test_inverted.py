import numpy as np
from pyspark.sql import functions as F

from tessera.operators.inverted import InvertedLists, recall


def brute(x, ids, queries, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = []
    for q in queries:
        s = u @ u[q]
        out += [(int(ids[q]), int(ids[j])) for j in [j for j in np.lexsort((ids, -s.round(9))) if j != q][:k]]
    return out


def test_clusters_need_few_comparisons(spark):
    rng = np.random.default_rng(1)
    x = np.repeat(rng.normal(size=(60, 16)), 50, axis=0) + 0.2 * rng.normal(size=(3000, 16))
    x[:1000] = x[0] + 0.01 * rng.normal(size=(1000, 16))  # a third in one place
    ids = np.arange(3000)
    v = spark.createDataFrame([(int(i), r.tolist()) for i, r in zip(ids, x)], "id long, v array<double>")
    index = InvertedLists.build(v, 60, cell=128)
    sizes = index.cells.agg(F.sum("size"), F.max("cells")).first()
    assert sizes[0] == 3000 and sizes[1] > 1
    queries = [i for i in range(1000, 3000, 40)]
    q = v.filter(F.col("id").isin(queries)).select(F.col("id").alias("query_id"), "v")
    found = index.search(q, 10, 3)
    want = brute(x, ids, queries, 10)
    r = recall(found, spark.createDataFrame(want, "query_id long, id long"), 3000).first()
    assert r.queries == 50 and r.recall >= 0.9 and r.share <= 0.1
    every = index.search(q, 10, 60).collect()
    assert sorted((r.query_id, r.id) for r in every) == sorted(want)
    assert {r.compared for r in every} == {3060} and all(1 <= r.rank <= 10 for r in every)


def test_recall_on_the_tables(spark):
    from tessera.plans import registry

    r = registry.QUERIES["vector_index_report"](spark, "/root/testdata/sf0.01").first()
    assert r.filed == 500 and r.recall >= 0.9 and r.share < 0.85

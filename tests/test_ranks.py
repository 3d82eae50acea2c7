"""Ranks over many tasks against a window, with one hot group, ties, nulls and no rows."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators.ranks import ranked
from tessera.sources.scratch import Scratch


def hits(spark, n):
    """A group of two thirds of all rows, small ones, one of null; scores with many ties."""
    g = F.when(F.col("id") % 3 < 2, 1).when(F.col("id") % 17 == 0, F.lit(None)).otherwise(F.col("id") % 40).cast("long")
    return spark.range(n).select(g.alias("g"), (F.hash("id") % 3).cast("double").alias("s"), F.concat(F.lit("k"), "id").alias("key"))


@pytest.mark.parametrize("n", [0, 1, 20_000])
def test_equals_a_window(spark, n):
    order = [F.desc("s"), F.col("key")]
    h = hits(spark, n)
    got = {r.key: (r.g, r.s, r["rank"]) for r in ranked(h, ["g"], order, Scratch(spark, "ranks")).collect()}
    want = h.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(*order)))
    assert got == {r.key: (r.g, r.s, r["rank"]) for r in want.collect()}
    assert len(got) == n


def test_a_hot_group_is_cut(spark):
    """The range shuffle spreads one group over the tasks: none holds more than some share of it."""
    h = hits(spark, 20_000).filter("g = 1").repartition(8)
    spread = h.repartitionByRange(4, "g", F.desc("s"), "key").groupBy(F.spark_partition_id().alias("p")).count()
    assert max(r["count"] for r in spread.collect()) < 0.5 * h.count()


def test_search_of_a_common_word(spark):
    """Every card holds the word of the query: ranks and places go by score and key."""
    from tessera.plans.search import search

    corpus = spark.range(3000).select(F.concat(F.lit("question.d"), "id").alias("stable_key"), F.concat(F.lit("d"), "id").alias("slug"), F.lit("common").alias("prompt"), F.concat(F.lit("common"), F.repeat(F.lit(" common"), (F.col("id") % 3).cast("int"))).alias("text"))
    asked = spark.createDataFrame([(1, "common"), (2, "question.d5"), (3, "nowhere")], "query_id long, query string")
    rows = search(spark, corpus, asked, limit=10).orderBy("query_id", "pos").collect()
    best = sorted(f"question.d{i}" for i in range(3000) if i % 3 == 2)[:10]
    first = [r for r in rows if r.query_id == 1]
    trigram_rank = {k: i + 1 for i, k in enumerate(sorted(f"question.d{i}" for i in range(3000)))}
    fts = {k: i + 1 for i, k in enumerate(sorted((f"question.d{i}" for i in range(3000)), key=lambda k: (-(int(k[10:]) % 3), k)))}
    want = sorted(fts, key=lambda k: (-round(1 / (60 + fts[k]) + 1 / (60 + trigram_rank[k]), 9), k))[:10]
    assert [r.stable_key for r in first] == want and set(want) & set(best)
    assert [(r.stable_key, r.exact_score) for r in rows if r.query_id == 2 and r.exact_score] == [("question.d5", 1.0)]
    assert not [r for r in rows if r.query_id == 3]

"""The vector index of inverted lists against the exact ranks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.inverted import InvertedLists, recall
from ..sources.cards import table
from ..sources.scratch import Scratch
from .registry import register
from .search import nearest


def _searched(spark: SparkSession, sf_dir: str, probed: float = 0.7) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(what the index finds, the exact ranks, lists and their sizes, number of vectors) for every vector whose id is divisible by 100; about sqrt(n) lists, of which the share ``probed`` is looked
    through. The vectors of the tables have no clusters, so that a recall of 0.9 takes most of them."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")).filter("id IS NOT NULL AND v IS NOT NULL")
    write = Scratch(spark, "lists").write
    n = e.count()
    lists = max(1, math.isqrt(n))
    index = InvertedLists.build(e, lists, write=write)
    q = e.filter("id % 100 = 0")
    found = write(index.search(q.select(F.col("id").alias("query_id"), "v"), 10, max(1, math.ceil(lists * probed))))
    exact = nearest(q.select(F.col("id").alias("query_id"), F.col("v").alias("q")), e.select(F.col("id").alias("vec_id"), F.col("v").alias("embedding")))
    return found, exact.select("query_id", F.col("vec_id").alias("id")), index.cells, n


@register(cards=False)
def vector_topk_approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of each query's exact ten the index finds, and what it compared the query with."""
    found, exact, _, _ = _searched(spark, sf_dir)
    both = exact.join(found.select("query_id", "id", F.lit(1).alias("got")), ["query_id", "id"], "left").groupBy("query_id").agg(F.count("got").alias("found"), F.count(F.lit(1)).alias("of"))
    return both.join(found.groupBy("query_id").agg(F.max("compared").alias("compared")), "query_id")


@register(cards=False)
def vector_index_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: vectors, lists, the largest list, queries, recall of the exact ten, share of the vectors compared."""
    found, exact, cells, n = _searched(spark, sf_dir)
    sizes = cells.agg(F.sum("size").alias("filed"), F.count(F.lit(1)).alias("lists"), F.max("size").alias("largest"))
    return recall(found, exact, n).join(sizes)  # rows of one

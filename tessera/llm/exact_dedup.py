"""Operator 5, exact dedup: distributed most-significant-digit radix partitioning.

Documents are split by successive bytes of their normalised text, many bytes to a digit (the
widths grow by a factor each round, so that a text of n bytes takes O(log n) rounds). A group is a
class of documents that agree on all bytes so far. Those that are alone, and those whose text has
ended, leave. Equality is that of all bytes; no digest decides it.

Scale: a round counts (group, digit) with map-side combining, so that a hot class is one row a
task, and joins these class rows back; Spark splits a skewed class in that join, as the class side
has one row a key. Only documents that share all bytes so far carry text into the next round.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LAST, Scratch, need, row_key, staying

#: White-space runs that are not yet a single blank: replacing only these equals replacing every run.
RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text) -> F.Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), RUNS, " ")


def classes_of(spark: SparkSession, docs: DataFrame, first: int = 256, growth: int = 16) -> DataFrame:
    """doc_id and text_key (as row_key has them), sha, keep (the smallest doc_id of the class), size, grp (a number of the class): one row for each input row."""
    scratch = Scratch(spark, "exact")
    text = normalised(F.col("text"))
    ident, key = row_key()
    state = need(docs, "doc_id", "text").select(
        F.monotonically_increasing_id().alias("rid"), ident.alias("doc_id"), key.alias("text_key"), F.sha2(text.cast("binary"), 256).alias("sha"), F.lit(-1).cast("long").alias("grp"), text.cast("binary").alias("rest")
    )
    own = ("rid", "doc_id", "text_key", "sha")
    done: list[DataFrame] = []
    width = first
    while True:
        cur = state.withColumn("digit", F.substring("rest", 1, width)).withColumn("ended", F.length("rest") < width)
        classes = cur.groupBy("grp", "digit").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("keep"), F.min("rid").alias("g")).filter("n > 1")
        on = cur.join(classes, ["grp", "digit"], "left")
        stays = F.col("n").isNotNull() & ~F.col("ended")
        table = scratch.write(
            on.select(
                *own,
                F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep")).alias("keep"),
                F.coalesce("n", F.lit(1)).alias("size"),
                F.coalesce("g", "rid").alias("grp"),
                stays.alias("open"),
                F.when(stays, F.expr(f"substring(rest, {width + 1})")).alias("rest"),
            )
        )
        done.append(table.filter("not open"))
        state = table.filter("open").select(*own, "grp", "rest")
        del cur, classes, on
        scratch.free_shuffles()
        if state.limit(1).count() == 0:
            break
        width *= growth
    return reduce(DataFrame.unionByName, done).select("doc_id", "text_key", "sha", "keep", "size", "grp")


def exact_dedup(spark: SparkSession, docs: DataFrame, first: int = 256, growth: int = 16) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each input row.

    Null text counts as empty; empty texts are equal to each other. The smallest doc_id of a class
    stays; of rows with that same id, all count as kept. A null doc_id never wins: keep_id is then
    the smallest id of the class, or null if it has none (kept is false unless the row is alone).
    An empty table gives an empty result. Texts of any length are compared whole, 256 bytes at first. Other columns play no part.
    """
    real = lambda c: F.when(F.col(c) != LAST, F.col(c))
    kept = ((F.col("doc_id") == F.col("keep")) & (F.col("doc_id") != LAST)) | (F.col("size") == 1)
    return classes_of(spark, docs, first, growth).select(real("doc_id").alias("doc_id"), real("keep").alias("keep_id"), F.col("size").alias("group_size"), kept.alias("kept"), F.col("sha").alias("text_sha256"))


def keep_one(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One document of each class, with all its columns: that of the smallest doc_id (null orders last; of several texts with that id, which differ in white space, the one of the least hash)."""
    scratch = Scratch(spark, "keep")
    found = classes_of(spark, docs).select("doc_id", "text_key", "grp", "size")
    # a class of one row needs no look at the others
    found = scratch.write(found)
    first = found.filter("size > 1").groupBy("grp").agg(F.min(F.struct("doc_id", "text_key")).alias("first"))
    told = found.join(first, "grp", "left")
    return staying(scratch, docs, told.select("doc_id", "text_key", F.coalesce(F.struct("doc_id", "text_key") == F.col("first"), F.lit(True)).alias("stays")))

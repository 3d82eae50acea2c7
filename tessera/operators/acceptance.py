"""Acceptance of a batch of cards: it is imported twice, reviewed against what is published, and its candidates are held against labels. One row of figures and the gates that failed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import imports, review

GATES = ("malformed", "retry", "exact", "semantic", "open_stages")


def totals(items: DataFrame, name: str) -> DataFrame:
    """One row: files, those with problems, and those that changed nothing."""
    is_ = lambda a: F.count_if(F.col("action") == a)
    return items.agg(F.count(F.lit(1)).alias(f"{name}_files"), is_("invalid").alias(f"{name}_invalid"), is_("unchanged").alias(f"{name}_unchanged"))


def accept(tables: dict[str, DataFrame], batch: DataFrame, current: DataFrame, similar, settled, semantic: float = review.SEMANTIC) -> DataFrame:
    """batch: cards of an import with stage_id, body_hash, prompt, vector and label; current: stable_key, body_hash, prompt, vector, label of the published cards.

    ``similar`` as in review.import_candidates(); ``settled(df)`` ends a lineage by writing a table. A semantic candidate is right if the labels are equal; how many pairs are equal is told by
    the product of the labels' counts, so that these pairs are never made. Precision and recall are 1 where there is nothing to find. An empty batch fails the gates of candidates.
    Cards with problems get no stage.
    """
    cards = batch.select("source_ref", "stable_key", "content_hash", "problems", "en", "ru")
    first = imports.drafts(tables, cards, settled)
    again = imports.drafts({n: settled(df) for n, df in first.tables.items()}, cards, settled)
    sound = batch.filter(F.size("problems") == 0)
    found = settled(review.import_candidates(sound.select("stage_id", "stable_key", "body_hash", "prompt", "vector"), current.select("stable_key", "body_hash", "prompt", "vector"), similar, semantic=semantic, settled=settled))
    stages = review.stage_status(sound.select("stage_id", F.lit("open").alias("status")), found.withColumn("decision", F.lit("open")))
    of = lambda i: F.count_if(F.col("candidate_type") == review.TYPES[i])
    kinds = found.agg(of(0).alias("exact"), of(1).alias("lexical"), of(2).alias("semantic"))
    held = stages.agg(F.count(F.lit(1)).alias("stages"), F.count_if(F.col("open") > 0).alias("open_stages"), F.count_if(F.col("status") == "blocked").alias("blocked"))
    near = found.filter(F.col("candidate_type") == review.TYPES[2]).join(sound.select("stage_id", "label"), "stage_id").join(current.select(F.col("stable_key").alias("related_key"), F.col("label").alias("other")), "related_key")
    right = near.agg(F.count_if(F.col("label") == F.col("other")).alias("right"))
    n = lambda df, name: df.filter("label IS NOT NULL").groupBy("label").agg(F.count(F.lit(1)).alias(name))
    equal = n(sound, "a").join(n(current, "b"), "label").agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).alias("equal"))
    out = totals(first.items, "first")
    for one in (totals(again.items, "retry"), kinds, held, right, equal):
        out = out.join(one)  # rows of one
    share = lambda of: F.when(F.col(of) == 0, 1.0).otherwise(F.col("right") / F.greatest(F.col(of), F.lit(1)))
    failed = (
        F.col("first_invalid") != F.col("retry_invalid"),
        F.col("retry_unchanged") != F.col("first_files") - F.col("first_invalid"),
        F.col("exact") == 0,
        F.col("semantic") == 0,
        F.col("open_stages") == 0,
    )
    return out.select("*", share("semantic").alias("precision"), share("equal").alias("recall"), F.array_compact(F.array(*[F.when(c, F.lit(g)) for g, c in zip(GATES, failed, strict=True)])).alias("failed"))

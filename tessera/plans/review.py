"""Duplicates: exact prompt groups, open groups, lexical candidates block by block, semantic candidates, calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import comparable, cosine, fingerprint, trigrams
from ..sources.cards import cards, table
from ..operators import review
from ..operators.blocks import nearest_pairs, similar_sets
from ..sources.scratch import Scratch
from .registry import register
from .sql import GRAMS


@register("SELECT 'prompt-' || substr(sha256(p), 1, 16) AS group_id, count(*) AS n, min(stable_key) AS first_key FROM (SELECT stable_key, lower(trim(regexp_replace(prompt, '[ \\t\\n\\r]+', ' ', 'g'))) AS p FROM cards) WHERE p <> '' GROUP BY p HAVING count(*) >= 2")
def dup_exact_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cards(spark, sf_dir, "stable_key", "prompt").select("stable_key", comparable(F.col("prompt")).alias("p")).filter("p <> ''")
    g = c.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.min("stable_key").alias("first_key")).filter("n >= 2")
    return g.select(fingerprint("prompt-", F.col("p")).alias("group_id"), "n", "first_key")


@register(
    """, g AS (SELECT stable_key, doc_id, lower(trim(regexp_replace(prompt, '[ \\t\\n\\r]+', ' ', 'g'))) AS p FROM cards)
    SELECT p AS prompt, count(*) AS n, count(*) FILTER (WHERE doc_id % 3 = 0) AS decided, bool_and(doc_id % 3 = 0) AS resolved FROM g WHERE p <> '' GROUP BY p HAVING count(*) >= 2 /* FROM cards */"""
)
def dup_open_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A group is resolved once all of its members carry a terminal decision (those of every third document stand in)."""
    c = cards(spark, sf_dir, "doc_id", "prompt").select("doc_id", comparable(F.col("prompt")).alias("prompt"), (F.col("doc_id") % 3 == 0).alias("done")).filter("prompt <> ''")
    return c.groupBy("prompt").agg(F.count(F.lit(1)).alias("n"), F.count_if("done").alias("decided"), F.bool_and("done").alias("resolved")).filter("n >= 2")


def similar_pairs(left: DataFrame, right: DataFrame, threshold: float, itself: bool = False) -> DataFrame:
    """a, b, similarity of the prompts (key, prompt) of both sides whose trigram sets have a Jaccard similarity of ``threshold`` or more; with ``itself`` both sides are one table, and a < b."""
    sets = lambda df: df.select("key", F.array_join(trigrams(F.col("prompt")), "").alias("grams"))
    return similar_sets(sets(left), left if itself else sets(right), threshold, itself)


def similar_prompts(prompts: DataFrame, threshold: float = 0.55) -> DataFrame:
    return similar_pairs(prompts, prompts, threshold, itself=True)


@register(
    f""", p AS (SELECT min(stable_key) AS k, {GRAMS.format('prompt')} AS g FROM cards GROUP BY prompt),
    s AS (SELECT a.k AS a, b.k AS b, len(list_intersect(a.g, b.g)) * 1.0 / nullif(len(a.g) + len(b.g) - len(list_intersect(a.g, b.g)), 0) AS s FROM p a JOIN p b ON a.k < b.k)
    SELECT a, b, round(s, 6) AS similarity FROM s WHERE s >= 0.55 /* FROM cards */"""
)
def dup_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal prompts are one key, so that copies don't form pairs."""
    c = cards(spark, sf_dir, "stable_key", "prompt").groupBy("prompt").agg(F.min("stable_key").alias("key"))
    return similar_prompts(c).select("a", "b", F.round("similarity", 6).alias("similarity"))


@register(
    """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
    p AS (SELECT a.vec_id AS target, b.vec_id AS other, list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) AS s FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY round(s, 9) DESC, other) AS rank FROM p WHERE s >= 0.2)
    SELECT target, other, round(s, 6) AS similarity FROM r WHERE rank <= 25""",
    cards=False,
)
def dup_semantic_topk(spark: SparkSession, sf_dir: str, least: float = 0.2) -> DataFrame:
    """For every vector whose id is divisible by 100, candidates among all others."""
    e = table(spark, sf_dir, "embeddings")
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("v"))
    pairs = nearest_pairs(q, e.select(F.col("vec_id").alias("other"), F.col("embedding").alias("w")), least, ("q", "other"), 25, "other").select(F.col("q").alias("target"), "other", F.col("similarity").alias("s"))
    w = Window.partitionBy("target").orderBy(F.desc(F.round("s", 9)), "other")
    return pairs.withColumn("rank", F.row_number().over(w)).filter("rank <= 25").select("target", "other", F.round("s", 6).alias("similarity"))


@register(
    """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
    p AS (SELECT a.label = b.label AS truth, list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.5 AS guess FROM e a JOIN e b ON b.vec_id = a.vec_id + 1),
    c AS (SELECT count(*) FILTER (WHERE truth AND guess) AS tp, count(*) FILTER (WHERE NOT truth AND guess) AS fp, count(*) FILTER (WHERE truth AND NOT guess) AS fn, count(*) FILTER (WHERE NOT truth AND NOT guess) AS tn FROM p)
    SELECT *, coalesce(tp / nullif(tp + fp, 0), 1)::DOUBLE AS precision, coalesce(tp / nullif(tp + fn, 0), 1)::DOUBLE AS recall FROM c""",
    cards=False,
)
def calibration_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("label").alias("l2"), F.col("embedding").alias("v2"))
    return review.calibration(e.join(n, "vec_id").select((F.col("label") == F.col("l2")).alias("truth"), (cosine(F.col("embedding"), F.col("v2")) >= 0.5).alias("guess")))


@register(
    f""", c AS (SELECT doc_id, stable_key, prompt, sha256(prompt || chr(9) || coalesce(short_answer, '')) AS body_hash, embedding::DOUBLE[] AS v FROM cards LEFT JOIN embeddings ON vec_id = doc_id),
    i AS (SELECT doc_id AS stage_id, * EXCLUDE (doc_id), {GRAMS.format('prompt')} AS g FROM c WHERE doc_id % 100 = 0), o AS (SELECT *, {GRAMS.format('prompt')} AS g FROM c),
    p AS (SELECT stage_id, o.stable_key AS related_key, i.body_hash = o.body_hash AS same, len(list_intersect(i.g, o.g)) * 1.0::DOUBLE / nullif(len(i.g) + len(o.g) - len(list_intersect(i.g, o.g)), 0) AS lex,
      list_dot_product(i.v, o.v) / (sqrt(list_dot_product(i.v, i.v)) * sqrt(list_dot_product(o.v, o.v))) AS sem FROM i JOIN o ON i.stable_key <> o.stable_key),
    e AS (SELECT stage_id, related_key, 'exact_duplicate' AS candidate_type FROM p WHERE same),
    l AS (SELECT * FROM (SELECT stage_id, related_key, lex, row_number() OVER (PARTITION BY stage_id ORDER BY lex DESC, related_key) AS r FROM p WHERE NOT same AND lex >= 0.55) WHERE r <= 25),
    s AS (SELECT * FROM (SELECT p.stage_id, p.related_key, sem, row_number() OVER (PARTITION BY p.stage_id ORDER BY sem DESC, p.related_key) AS r FROM p LEFT JOIN l ON p.stage_id = l.stage_id AND p.related_key = l.related_key WHERE NOT same AND l.r IS NULL AND sem >= 0.4) WHERE r <= 25)
    SELECT stage_id, related_key, candidate_type, 1.0::DOUBLE AS score FROM e UNION ALL SELECT stage_id, related_key, 'lexical_neighbor', round(lex, 6) FROM l UNION ALL SELECT stage_id, related_key, 'semantic_neighbor', round(sem, 6) FROM s /* FROM cards */"""
)
def import_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every card whose id is divisible by 100 comes in again; what it may repeat. The vectors of the tables are spread widely: neighbours from 0.4 on."""
    c = cards(spark, sf_dir, "doc_id", "stable_key", "prompt", "short_answer").withColumn("body_hash", F.sha2(F.concat_ws("\t", "prompt", F.coalesce("short_answer", F.lit(""))), 256))
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    c = c.join(e, "doc_id", "left").drop("short_answer")
    found = review.import_candidates(c.filter("doc_id % 100 = 0").withColumnRenamed("doc_id", "stage_id"), c.drop("doc_id"), similar_pairs, semantic=0.4, settled=Scratch(spark, "import_review").write)
    return found.select("stage_id", "related_key", "candidate_type", F.round(F.coalesce("exact_score", "lexical_score", "semantic_score"), 6).alias("score"))


@register(
    """, g AS (SELECT doc_id, stable_key, lower(trim(regexp_replace(prompt, '[ \t\n\r]+', ' ', 'g'))) AS p FROM cards),
    s AS (SELECT p, count(*) AS n, min(stable_key) AS first_key FROM g WHERE p <> '' GROUP BY p HAVING count(*) > 1),
    d AS (SELECT a.p, count(*) AS decided FROM g a JOIN g b ON a.p = b.p AND a.stable_key < b.stable_key AND (a.doc_id + b.doc_id) % 3 = 0 WHERE a.p <> '' AND abs(a.doc_id - b.doc_id) <= 500 GROUP BY 1)
    SELECT first_key, n, n * (n - 1) // 2 AS pairs, coalesce(decided, 0) AS decided, coalesce(decided, 0) = n * (n - 1) // 2 AS resolved FROM s LEFT JOIN d USING (p) /* FROM cards */"""
)
def duplicate_group_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal prompts; pairs of near ids whose sum is divisible by three stand in for decided ones."""
    c = cards(spark, sf_dir, "doc_id", "stable_key", "prompt").select("doc_id", F.col("stable_key").alias("key"), comparable(F.col("prompt")).alias("prompt")).filter("prompt <> ''")
    # ids at most 500 apart lie in the same stretch of 500 or in neighbouring ones, so that no prompt pairs all of its cards
    stretch = F.floor(F.col("doc_id") / 500)
    x = c.select("prompt", F.col("key").alias("a"), F.col("doc_id").alias("i"), stretch.alias("at"))
    y = c.select("prompt", F.col("key").alias("b"), F.col("doc_id").alias("j"), F.explode(F.array(stretch - 1, stretch, stretch + 1)).alias("at"))
    near = x.join(y, ["prompt", "at"]).filter("a < b AND (i + j) % 3 = 0 AND abs(i - j) <= 500").select("a", "b", F.lit("merge").alias("decision"))
    return review.duplicate_groups(c.select("key", "prompt"), near).select("first_key", "n", "pairs", "decided", "resolved")

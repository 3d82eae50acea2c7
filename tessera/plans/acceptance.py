"""Acceptance of a batch: every document whose id is divisible by 100 comes in beside the published others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import acceptance, imports
from ..sources.cards import table
from ..sources.scratch import Scratch
from .imports import LEAST, incoming, sources
from .registry import register
from .review import similar_pairs
from .sql import GRAMS


@register(
    f""", c AS (SELECT doc_id, stable_key, prompt, sha256(prompt || chr(9) || coalesce(short_answer, '')) AS body_hash, embedding::DOUBLE[] AS v, label, {GRAMS.format('prompt')} AS g FROM cards LEFT JOIN embeddings ON vec_id = doc_id),
    i AS (SELECT * FROM c WHERE doc_id % 100 = 0 AND NOT coalesce(length(prompt) < {LEAST}, false)), o AS (SELECT * FROM c WHERE doc_id % 100 <> 0),
    p AS (SELECT i.doc_id AS stage_id, o.stable_key AS related_key, i.label = o.label AS same_label, i.body_hash = o.body_hash AS same, len(list_intersect(i.g, o.g)) * 1.0::DOUBLE / nullif(len(i.g) + len(o.g) - len(list_intersect(i.g, o.g)), 0) AS lex,
      list_dot_product(i.v, o.v) / (sqrt(list_dot_product(i.v, i.v)) * sqrt(list_dot_product(o.v, o.v))) AS sem FROM i JOIN o ON true),
    l AS (SELECT * FROM (SELECT stage_id, related_key, row_number() OVER (PARTITION BY stage_id ORDER BY lex DESC, related_key) AS r FROM p WHERE NOT same AND lex >= 0.55) WHERE r <= 25),
    s AS (SELECT * FROM (SELECT p.stage_id, p.related_key, same_label, row_number() OVER (PARTITION BY p.stage_id ORDER BY sem DESC, p.related_key) AS r FROM p LEFT JOIN l ON p.stage_id = l.stage_id AND p.related_key = l.related_key WHERE NOT same AND l.r IS NULL AND sem >= 0.3) WHERE r <= 25),
    k AS (SELECT DISTINCT stage_id FROM (SELECT stage_id FROM p WHERE same UNION ALL SELECT stage_id FROM l UNION ALL SELECT stage_id FROM s)),
    b AS (SELECT (SELECT count(*) FROM c WHERE doc_id % 100 = 0) AS first_files, (SELECT count(*) FROM i) AS stages, (SELECT count(*) FROM p WHERE same) AS exact, (SELECT count(*) FROM l) AS lexical, (SELECT count(*) FROM s) AS semantic,
      (SELECT count(*) FROM k) AS open_stages, (SELECT count(*) FROM s WHERE same_label) AS "right", (SELECT count(*) FROM p WHERE same_label) AS equal)
    SELECT *, first_files - stages AS first_invalid, 0 AS first_unchanged, first_files AS retry_files, first_files - stages AS retry_invalid, stages AS retry_unchanged, open_stages AS blocked, CASE WHEN semantic = 0 THEN 1 ELSE "right" / semantic END::DOUBLE AS precision,
      CASE WHEN equal = 0 THEN 1 ELSE "right" / equal END::DOUBLE AS recall, concat_ws(',', CASE WHEN exact = 0 THEN 'exact' END, CASE WHEN semantic = 0 THEN 'semantic' END, CASE WHEN open_stages = 0 THEN 'open_stages' END) AS failed FROM b /* FROM cards */"""
)
def batch_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of the tables are spread widely: neighbours from 0.3 on; their labels tell which are right."""
    scratch = Scratch(spark, "acceptance")
    hashed = F.sha2(F.concat_ws("\t", "prompt", F.coalesce("short_answer", F.lit(""))), 256).alias("body_hash")
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), "label")
    docs = sources(spark, sf_dir, scratch)
    c = scratch.write(docs.select("doc_id", "stable_key", "prompt", hashed).join(e, "doc_id", "left"))
    batch = scratch.write(incoming(docs, "doc_id % 100 = 0").join(c.filter("doc_id % 100 = 0").withColumnRenamed("doc_id", "stage_id"), "stable_key"))
    before = imports.published(imports.empty(spark), incoming(docs, "doc_id % 100 <> 0"), scratch.write)
    out = acceptance.accept({n: scratch.write(df) for n, df in before.tables.items()}, batch, c.filter("doc_id % 100 <> 0"), similar_pairs, scratch.write, semantic=0.3)
    return out.withColumn("failed", F.array_join("failed", ","))

"""The quality report: documents are questions, labels placements, vectors proposals, and events the outbox."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import comparable
from ..operators import quality
from ..sources.cards import cards, table
from .catalog import _RULES
from .registry import register


@register(
    rf""", {_RULES},
    q AS (SELECT c.doc_id, c.stable_key, c.locale, lower(trim(regexp_replace(c.prompt, '[ \t\n\r]+', ' ', 'g'))) AS p, x.codes, c.short_answer IS NOT NULL AS task, split_part(c.text, chr(10), 3) AS solution, c.topic,
      EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = c.doc_id AND l.quality = 1) AS placed, (SELECT max(e.label % 3) FROM embeddings e WHERE e.vec_id = c.doc_id) AS decision FROM cards c JOIN x ON x.stable_key = c.stable_key),
    l AS (SELECT DISTINCT doc_id, locale FROM (SELECT doc_id, locale FROM q UNION ALL SELECT doc_id, 'en' FROM q WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 'ru' FROM q WHERE doc_id % 4 = 0) WHERE locale IS NOT NULL),
    g AS (SELECT p, count(*) AS n, min(stable_key) AS first_key FROM q WHERE p <> '' GROUP BY p HAVING count(*) > 1),
    d AS (SELECT g.p, CASE WHEN q.doc_id % 2 = 0 THEN 'keep_separate' ELSE 'open' END AS decision FROM q JOIN g ON q.p = g.p AND q.stable_key > g.first_key),
    s AS (SELECT g.p, n * (n - 1) // 2 = coalesce((SELECT count(*) FROM d WHERE d.p = g.p AND decision = 'keep_separate'), 0) AS resolved FROM g),
    o AS (SELECT count(*) AS published, count(*) FILTER (WHERE placed) AS released, count(*) FILTER (WHERE NOT placed AND decision = 2) AS accepted_pending, count(*) FILTER (WHERE NOT placed AND decision = 1) AS proposed,
        count(*) FILTER (WHERE NOT placed AND coalesce(decision, 0) = 0) AS unplaced, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.doc_id = q.doc_id AND l.locale = 'en')) AS missing_en,
        count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.doc_id = q.doc_id AND l.locale = 'ru')) AS missing_ru, count(*) FILTER (WHERE codes <> '') AS degenerate, count(*) FILTER (WHERE task) AS tasks,
        count(*) FILTER (WHERE task AND topic <> '') AS task_families, count(*) FILTER (WHERE task AND regexp_matches(solution, '\S')) AS embedded_solutions, count(*) FILTER (WHERE task AND locale = 'en' AND regexp_matches(solution, '\S')) AS boundary_violations FROM q),
    n AS (SELECT o.*, (SELECT count(*) FROM l JOIN cards c USING (doc_id) WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = l.doc_id AND c.locale = l.locale)) AS bare_locales,
      (SELECT count(*) FROM s WHERE NOT resolved) AS open_groups, (SELECT count(*) FROM s WHERE resolved) AS resolved_groups, (SELECT coalesce(string_agg(decision || ':' || k, ',' ORDER BY k DESC, decision), '') FROM (SELECT decision, count(*) AS k FROM d GROUP BY decision)) AS decisions,
      (SELECT count(*) FROM events WHERE event_type = 'error') AS outbox_pending FROM o)
    SELECT *, concat_ws(',', CASE WHEN released < published THEN 'placement_debt' END, CASE WHEN missing_ru > 0 THEN 'missing_russian' END, CASE WHEN degenerate > 0 THEN 'degenerate_prompts' END, CASE WHEN open_groups > 0 THEN 'open_duplicate_groups' END,
      CASE WHEN outbox_pending > 0 THEN 'outbox_lag' END, CASE WHEN bare_locales > 0 THEN 'missing_vectors' END, CASE WHEN boundary_violations > 0 THEN 'task_boundary' END) AS warnings FROM n /* FROM cards */"""
)
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks are the documents of two lines or more, the third line their solution; those in English are of the contract. Members of a group of equal prompts are paired with its first."""
    c = cards(spark, sf_dir, "doc_id", "stable_key", "locale", "topic", "prompt", "short_answer", "text")
    word = lambda col, n: F.split_part(F.coalesce(col, F.lit("")), F.lit(" "), F.lit(n))
    title = F.concat(word("short_answer", 1), F.lit(" "), word("short_answer", 2))
    task = F.struct(F.col("topic").alias("task_family_key"), F.when(F.col("locale") == "en", "task-brief.v1").alias("contract_version"), F.split_part("text", F.lit("\n"), F.lit(3)).alias("solution"))
    payload = F.to_json(F.struct(F.when(F.col("short_answer").isNotNull(), task).alias("task")))
    codes = rules.prompt_codes(F.col("prompt"), F.col("short_answer"), title, word("prompt", 1))
    q = c.select("doc_id", "stable_key", F.col("doc_id").alias("revision_id"), "locale", comparable(F.col("prompt")).alias("prompt"), codes.alias("codes"), payload.alias("payload"))
    own = F.array_compact(F.array(F.col("locale"), F.when(F.col("doc_id") % 3 == 0, "en"), F.when(F.col("doc_id") % 4 == 0, "ru")))
    some = c.select(F.col("doc_id").alias("revision_id"), "locale", own.alias("own"))
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("revision_id"), "label")
    vectors = some.select("revision_id", "locale").join(e, "revision_id", "left_semi")
    placed = table(spark, sf_dir, "labels").filter("quality = 1").select(F.concat(F.lit("question.d"), "doc_id").alias("stable_key"))
    decision = F.when(F.col("label") % 3 == 2, "accepted").when(F.col("label") % 3 == 1, "proposed").otherwise("rejected")
    prompts = q.select("doc_id", "stable_key", "prompt").filter("prompt <> ''")
    firsts = prompts.groupBy("prompt").agg(F.min("stable_key").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    pairs = prompts.join(firsts, "prompt").filter("stable_key > a").select("a", F.col("stable_key").alias("b"), F.when(F.col("doc_id") % 2 == 0, "keep_separate").otherwise("open").alias("decision"))
    outbox = table(spark, sf_dir, "events").select(F.when(F.col("event_type") != "error", F.col("ts")).alias("published_at"))
    out = quality.report(q, some.select("revision_id", F.explode("own").alias("locale")), vectors, placed, e.select("revision_id", decision.alias("decision")), pairs, outbox)
    told = F.array_join(F.transform("decisions", lambda x: F.concat_ws(":", x["key"], x["n"])), ",").alias("decisions")
    return out.select(*[c for c in out.columns if c not in ("decisions", "warnings")], told, F.array_join("warnings", ",").alias("warnings"))

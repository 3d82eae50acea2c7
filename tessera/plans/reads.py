"""Catalog and question reads: clients of the shop stand for questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reads
from ..sources.cards import table
from .registry import register


def tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(questions, locales, topics). The last digit of an id tells its locales; segment and source are topics."""
    c = table(spark, sf_dir, "clients").withColumn("stable_key", F.concat(F.lit("question.c"), "client_id")).withColumn("revision_id", F.concat(F.lit("r"), "client_id"))
    kind = F.when(F.col("client_id") % 7 == 0, "fixture").when(F.col("client_id") % 11 == 0, "audit").otherwise("production")
    status = F.when(F.col("balance") < 0, "archived").otherwise("published")
    q = c.select("stable_key", F.concat(F.lit("w"), F.col("nation_id") % 2).alias("workspace"), status.alias("status"), kind.alias("content_kind"), F.col("segment").alias("level"), F.col("city").alias("company"), F.col("source").alias("track"), "revision_id")
    d = F.col("client_id") % 10
    own = F.array_compact(F.array(F.when(d < 8, "en"), F.when((d % 2) == 0, "ru"), F.when(d == 9, "de"), F.when(d % 5 == 4, "fr")))
    locales = c.select("revision_id", F.explode(own).alias("locale"), "name", "email").select("revision_id", "locale", F.concat_ws(" ", "locale", "name").alias("prompt"), F.col("email").alias("short_answer"))
    pair = F.array(F.struct(F.col("segment").alias("title"), F.lit("secondary").alias("relation")), F.struct(F.col("source").alias("title"), F.lit("primary").alias("relation")))
    topics = c.select("stable_key", F.inline(pair)).filter("title IS NOT NULL").select("stable_key", F.concat(F.lit("topic."), "title").alias("topic_key"), "title", "relation")
    return q, locales, topics


_TABLES = """WITH q AS (SELECT 'question.c' || client_id AS stable_key, 'w' || (nation_id % 2) AS workspace, CASE WHEN balance < 0 THEN 'archived' ELSE 'published' END AS status, CASE WHEN client_id % 7 = 0 THEN 'fixture' WHEN client_id % 11 = 0 THEN 'audit' ELSE 'production' END AS content_kind,
      segment AS level, city AS company, source AS track, client_id, name, email FROM clients),
    l AS (SELECT client_id, unnest(list_filter([CASE WHEN client_id % 10 < 8 THEN 'en' END, CASE WHEN client_id % 2 = 0 THEN 'ru' END, CASE WHEN client_id % 10 = 9 THEN 'de' END, CASE WHEN client_id % 5 = 4 THEN 'fr' END], lambda x: x IS NOT NULL)) AS locale FROM clients)"""


@register(
    f"""{_TABLES}, m AS (SELECT * FROM q WHERE workspace = 'w1' AND status = 'published' AND content_kind = 'production' AND lower(coalesce(level, '')) = 'export' AND (coalesce(track, '') = 'web' OR coalesce(level, '') = 'web') AND EXISTS (SELECT 1 FROM l WHERE l.client_id = q.client_id AND locale = 'ru'))
    SELECT stable_key, company, (SELECT string_agg(locale, ',' ORDER BY locale) FROM l WHERE l.client_id = m.client_id) AS locales, concat_ws(',', 'topic.' || track, 'topic.' || level) AS topics, (SELECT count(*) FROM m) AS total,
      (SELECT count(*) FROM q WHERE workspace = 'w1' AND status = 'published' AND content_kind = 'fixture') AS excluded_fixtures, (SELECT count(*) FROM q WHERE workspace = 'w1' AND status = 'published' AND content_kind <> 'production') AS excluded_non_production
    FROM m ORDER BY stable_key LIMIT 50 OFFSET 2""",
    cards=False,
)
def catalog_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the catalog by locale, topic and level, each row with the counts of the whole answer."""
    request = reads.CatalogRequest("w1", "ru", topic="topic.web", level="Export", offset=2, limit=50)
    page, counts = reads.catalog(request, *tables(spark, sf_dir))
    return page.join(counts).select("stable_key", "company", F.array_join("locales", ",").alias("locales"), F.array_join(F.transform("topics", lambda t: t["topic_key"]), ",").alias("topics"), "total", "excluded_fixtures", "excluded_non_production")


@register(
    f"""{_TABLES}, r AS (SELECT q.*, l.locale, row_number() OVER (PARTITION BY stable_key ORDER BY CASE locale WHEN 'ru' THEN 0 WHEN 'en' THEN 1 ELSE 3 END, locale) AS n FROM q JOIN l USING (client_id) WHERE status = 'published' AND workspace IS NOT NULL)
    SELECT stable_key, workspace, locale, concat_ws(' ', locale, name) AS prompt, level, concat_ws(',', track, level) AS topics FROM r WHERE n = 1""",
    cards=False,
)
def question_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every published question, asked for in Russian, in the best locale that it has."""
    q, locales, topics = tables(spark, sf_dir)
    out = reads.in_best_locale(q.select("stable_key", "workspace", F.lit("ru").alias("wanted")), q, locales, topics)
    return out.select("stable_key", "workspace", "locale", "prompt", "level", F.array_join(F.transform("topics", lambda t: t["title"]), ",").alias("topics"))

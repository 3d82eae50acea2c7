"""Reads of questions: the catalog with all its filters and counts, and one question in the best locale.

questions  stable_key, workspace, status, content_kind, level, company, track, revision_id
locales    revision_id, locale, prompt, short_answer
topics     stable_key, topic_key, title, relation

A filter is part of the plan only where it is asked for, so that each reaches the scan; locale and topic are semi joins, which never multiply questions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST = 2000


@dataclass(frozen=True)
class CatalogRequest:
    """An empty filter asks for nothing. Level, company and track are compared without case."""

    workspace: str
    locale: str = "en"
    topic: str = ""
    track: str = ""
    level: str = ""
    company: str = ""
    fixtures: bool = False
    offset: int = 0
    limit: int = 100

    def __post_init__(self):
        if not self.workspace.strip():
            raise ValueError("a workspace is required")


def published(questions: DataFrame, workspace: str) -> DataFrame:
    return questions.filter((F.col("workspace") == workspace.strip()) & (F.col("status") == "published"))


def matching(request: CatalogRequest, questions: DataFrame, locales: DataFrame, topics: DataFrame) -> DataFrame:
    """The questions that a request asks for, all pages."""
    q = published(questions, request.workspace)
    if not request.fixtures:
        q = q.filter("content_kind = 'production'")
    for column, wanted in (("level", request.level), ("company", request.company), ("track", request.track)):
        if wanted.strip():
            q = q.filter(F.lower(F.coalesce(F.col(column), F.lit(""))) == wanted.strip().lower())
    if request.topic.strip():
        q = q.join(topics.filter(F.col("topic_key") == request.topic.strip()).select("stable_key"), "stable_key", "left_semi")
    return q.join(locales.filter(F.col("locale") == (request.locale.strip() or "en")).select("revision_id"), "revision_id", "left_semi")


def topics_of(topics: DataFrame) -> DataFrame:
    """stable_key, topics array<struct<topic_key, title, relation>>: primary ones first, then by key."""
    first = F.when(F.col("relation") == "primary", 0).otherwise(1).alias("o")
    return topics.groupBy("stable_key").agg(F.array_sort(F.collect_set(F.struct(first, "topic_key", "title", "relation"))).alias("t")).select("stable_key", F.transform("t", lambda x: x.dropFields("o")).alias("topics"))


def catalog(request: CatalogRequest, questions: DataFrame, locales: DataFrame, topics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the page, in order of stable_key, with locales and topics; one row: total, excluded_fixtures, excluded_non_production). Only the page's own locales and topics are gathered."""
    all_ = matching(request, questions, locales, topics)
    page = all_.orderBy("stable_key").offset(max(request.offset, 0)).limit(min(request.limit if request.limit > 0 else 100, MOST))
    own = locales.join(page.select("revision_id"), "revision_id", "left_semi").groupBy("revision_id").agg(F.array_sort(F.collect_set("locale")).alias("locales"))
    page = page.join(own, "revision_id", "left").join(topics_of(topics.join(page.select("stable_key"), "stable_key", "left_semi")), "stable_key", "left")
    out = published(questions, request.workspace).agg(F.count_if(F.col("content_kind") == "fixture").alias("excluded_fixtures"), F.count_if(F.col("content_kind") != "production").alias("excluded_non_production"))
    if request.fixtures:
        out = out.select(F.lit(0).cast("long").alias("excluded_fixtures"), F.lit(0).cast("long").alias("excluded_non_production"))
    return page, all_.agg(F.count(F.lit(1)).alias("total")).join(out)  # rows of one


def preference(locale: Column, wanted: Column) -> Column:
    """The wanted locale first, then English, Russian, and others by name."""
    return F.struct(F.when(locale == wanted, 0).when(locale == "en", 1).when(locale == "ru", 2).otherwise(3).alias("o"), locale.alias("l"))


def in_best_locale(asked: DataFrame, questions: DataFrame, locales: DataFrame, topics: DataFrame) -> DataFrame:
    """asked (stable_key, workspace, wanted): each published question in the wanted locale, or the next best one, with its topics; nothing for a question that isn't there."""
    q = asked.join(questions.filter("status = 'published'"), ["stable_key", "workspace"]).join(locales, "revision_id")
    best = q.groupBy("stable_key", "workspace", "wanted").agg(F.min_by(F.struct("locale", "prompt", "short_answer", "level", "company"), preference(F.col("locale"), F.col("wanted"))).alias("x"))
    return best.select("stable_key", "workspace", "wanted", "x.*").join(topics_of(topics.join(asked.select("stable_key"), "stable_key", "left_semi")), "stable_key", "left")

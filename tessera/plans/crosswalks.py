"""Crosswalk queries: items of the shop stand for cards, their brands and kinds for topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import crosswalk
from ..sources.cards import table
from .registry import register

PROGRAM, VERSION, SOURCE = "program.shop", "taxonomy.v2", "registry"


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(catalog, entries of before, registry). Two of three cards have their brand as primary topic, the others their kind as the only one; the registry holds brands of more than 20 items; of the entries of before every fifth is
    accepted, and some are of cards that are gone."""
    i = table(spark, sf_dir, "items")
    topic = lambda c, r: F.struct(F.col(c).alias("title"), F.lit(r).alias("relation"))
    topics = F.when(F.col("item_id") % 3 > 0, F.array(topic("kind", "secondary"), topic("brand", "primary"))).otherwise(F.array(topic("kind", "secondary")))
    catalog = i.filter("item_id % 11 <> 0").select(F.concat(F.lit("item."), "item_id").alias("stable_key"), F.concat(F.lit("r"), "item_id").alias("revision_id"), F.md5(F.coalesce("name", F.lit(""))).alias("content_hash"), topics.alias("topics"))
    some = F.col("item_id") % 5 == 0
    before = i.filter("item_id % 2 = 0").select(F.concat(F.lit("item."), "item_id").alias("stable_key"), F.lit("r").alias("revision_id"), F.lit("h").alias("content_hash"), F.lit("program.old").alias("program_key"), F.lit("path.kept").alias("path_key"), F.lit("domain.kept").alias("domain_key"), F.when(some, "accepted").otherwise("proposed").alias("mapping_state"), F.lit("taxonomy.v1").alias("mapping_version"), F.lit("editor").alias("source"))
    decisions = i.filter("brand IS NOT NULL").groupBy(F.col("brand").alias("title")).agg(F.count(F.lit(1)).alias("n"), F.min("kind").alias("k")).filter("n > 20").select("title", F.concat(F.lit("path."), F.lower("title")).alias("path_key"), F.concat(F.lit("domain."), "k").alias("domain_key"))
    return catalog, before, decisions


_SQL = """WITH c AS (SELECT 'item.' || item_id AS stable_key, 'r' || item_id AS revision_id, CASE WHEN item_id % 3 > 0 THEN brand ELSE kind END AS topic, item_id FROM items WHERE item_id % 11 <> 0),
    d AS (SELECT brand AS title, 'path.' || lower(brand) AS path_key, 'domain.' || min(kind) AS domain_key FROM items WHERE brand IS NOT NULL GROUP BY brand HAVING count(*) > 20),
    p AS (SELECT 'item.' || item_id AS stable_key, item_id % 5 = 0 AS accepted FROM items WHERE item_id % 2 = 0)"""


@register(
    f"""{_SQL} SELECT stable_key, CASE WHEN p.accepted THEN 'r' ELSE c.revision_id END AS revision_id, CASE WHEN p.accepted THEN 'accepted' WHEN d.path_key IS NOT NULL THEN 'proposed' ELSE 'unmapped' END AS mapping_state,
      CASE WHEN p.accepted THEN 'path.kept' ELSE d.path_key END AS path_key, CASE WHEN p.accepted THEN 'domain.kept' ELSE d.domain_key END AS domain_key, CASE WHEN p.accepted THEN 'taxonomy.v1' WHEN d.path_key IS NOT NULL THEN '{VERSION}' END AS mapping_version
    FROM c LEFT JOIN p USING (stable_key) LEFT JOIN d ON d.title = c.topic""",
    cards=False,
)
def crosswalk_proposal(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = crosswalk.propose(*_inputs(spark, sf_dir), PROGRAM, VERSION, SOURCE)
    return out.select("stable_key", "revision_id", "mapping_state", "path_key", "domain_key", "mapping_version")


@register(
    f"""{_SQL} SELECT p.stable_key, CASE WHEN p.accepted THEN 'accepted' WHEN d.path_key IS NOT NULL THEN 'accepted' ELSE 'unmapped' END AS mapping_state, CASE WHEN p.accepted THEN 'path.kept' ELSE d.path_key END AS path_key,
      CASE WHEN p.accepted THEN 'editor' WHEN d.path_key IS NOT NULL THEN '{SOURCE}' ELSE 'editor' END AS source, c.stable_key IS NULL AS missing
    FROM p LEFT JOIN c USING (stable_key) LEFT JOIN d ON d.title = c.topic""",
    cards=False,
)
def crosswalk_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of before after a review."""
    catalog, before, decisions = _inputs(spark, sf_dir)
    return crosswalk.accept(before, catalog, decisions, PROGRAM, VERSION, SOURCE).select("stable_key", "mapping_state", "path_key", "source", "missing")


@register(
    f"""{_SQL}, e AS (SELECT c.topic, CASE WHEN p.accepted THEN 'accepted' WHEN d.path_key IS NOT NULL THEN 'proposed' ELSE 'unmapped' END AS state, CASE WHEN p.accepted THEN 'path.kept' ELSE d.path_key END AS path FROM c LEFT JOIN p USING (stable_key) LEFT JOIN d ON d.title = c.topic)
    SELECT 'state' AS counter, state AS key, count(*) AS n FROM e GROUP BY ALL UNION ALL SELECT 'path', path, count(*) FROM e WHERE state <> 'unmapped' GROUP BY ALL UNION ALL SELECT 'unmapped', coalesce(topic, '<missing topic>'), count(*) FROM e WHERE state = 'unmapped' GROUP BY ALL""",
    cards=False,
)
def crosswalk_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's counters as rows."""
    one = crosswalk.counters(crosswalk.propose(*_inputs(spark, sf_dir), PROGRAM, VERSION, SOURCE))
    part = lambda name, entries: one.select(F.lit(name).alias("counter"), F.explode(entries).alias("key", "n"))
    states = F.map_filter(F.create_map(*[x for s in crosswalk.STATES for x in (F.lit(s), F.col(s))]), lambda _, n: n > 0)
    topics = F.map_from_entries(F.transform("unmapped_topics", lambda t: F.struct(t["title"], t["cards"])))
    return part("state", states).union(part("path", F.col("by_path"))).union(part("unmapped", topics))

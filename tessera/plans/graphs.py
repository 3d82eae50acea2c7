"""Edge graph queries over conversations: each turn follows the one before; role switches and repeats close the loops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import from_test
from ..operators.graph import KINDS, cyclic_nodes, edge_problem, evidence_gap, neighbourhood
from ..sources.cards import table
from .registry import register


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"))
    key = lambda t: F.concat(F.lit("c"), "conv_id", F.lit("."), t)
    return c.join(nxt, ["conv_id", "turn"]).select(key(F.col("turn")).alias("src"), key(F.col("turn") + 1).alias("dst")).distinct()


_EDGES = "e AS (SELECT DISTINCT 'c' || a.conv_id || '.' || a.turn AS src, 'c' || a.conv_id || '.' || (a.turn + 1) AS dst FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"


@register(f"WITH {_EDGES}, k AS (SELECT DISTINCT 'c' || conv_id || '.1' AS key FROM conversations WHERE conv_id % 10 = 0) SELECT key, dst AS other, 'out' AS direction FROM e JOIN k ON key = src UNION ALL SELECT key, src, 'in' FROM e JOIN k ON key = dst", cards=False)
def graph_neighborhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = table(spark, sf_dir, "conversations").filter("conv_id % 10 = 0").select(F.concat(F.lit("c"), "conv_id", F.lit(".1")).alias("key")).distinct()
    return neighbourhood(edges(spark, sf_dir), k)


@register(
    """WITH RECURSIVE e AS (SELECT DISTINCT a.user_id AS src, b.user_id AS dst FROM events a JOIN events b ON b.event_id = a.event_id + 1 AND a.event_type = 'purchase' AND b.event_type = 'purchase'),
    r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src) SELECT DISTINCT src AS node FROM r WHERE src = dst""",
    cards=False,
)
def graph_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users on a cycle of purchases: an edge leads from the user of one to that of the next event, if it is a purchase too."""
    from .lifecycle import with_checkpoints

    with_checkpoints(spark)
    e = table(spark, sf_dir, "events").filter("event_type = 'purchase'")
    after = e.select((F.col("event_id") - 1).alias("event_id"), F.col("user_id").alias("dst"))
    return cyclic_nodes(e.select("event_id", F.col("user_id").alias("src")).join(after, "event_id").select("src", "dst"))


#: How the events of the tables stand for edges: their types are kinds, their values confidences.
_KINDS = {"click": "related", "view": "prerequisite", "purchase": "follow_up"}


def proposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.coalesce(*[F.when(F.col("event_type") == t, k) for t, k in _KINDS.items()], F.col("event_type"))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("src"), ((F.col("event_id") * 7) % 100).cast("string").alias("dst"), kind.alias("kind"),
        F.least(F.floor(F.col("value")) / 50, F.lit(2.0)).alias("confidence"), F.when(F.col("event_id") % 3 == 0, "why").otherwise("").alias("rationale"), F.when(F.col("event_id") % 11 == 0, "Smoke run").otherwise("editor").alias("source"),
    )


_PROPOSED = """e AS (SELECT event_id AS id, user_id::VARCHAR AS src, ((event_id * 7) % 100)::VARCHAR AS dst, CASE event_type WHEN 'click' THEN 'related' WHEN 'view' THEN 'prerequisite' WHEN 'purchase' THEN 'follow_up' ELSE event_type END AS kind,
  least(floor(value) / 50, 2.0) AS confidence, CASE WHEN event_id % 3 = 0 THEN 'why' ELSE '' END AS rationale, CASE WHEN event_id % 11 = 0 THEN 'Smoke run' ELSE 'editor' END AS source FROM events)"""
_KNOWN = ", ".join(f"'{k}'" for k in KINDS)


@register(
    f"WITH {_PROPOSED} SELECT id, CASE WHEN src = dst THEN 'distinct_ends' WHEN kind NOT IN ({_KNOWN}) THEN 'unknown_kind' WHEN confidence < 0 OR confidence > 1 THEN 'confidence_range' WHEN confidence = 1 AND rationale = '' THEN 'needs_evidence' WHEN contains(lower(source), 'smoke') THEN 'test_provenance' END AS problem FROM e",
    cards=False,
)
def edge_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proposed(spark, sf_dir).select("id", edge_problem(production=F.lit(True)).alias("problem"))


@register(
    f"WITH {_PROPOSED}, a AS (SELECT * FROM e WHERE kind IN ({_KNOWN}) AND src <> dst) SELECT kind, count(*) AS n, count(*) FILTER (WHERE confidence = 1 AND rationale = '') AS gaps, count(*) FILTER (WHERE contains(lower(source), 'smoke')) AS test_origin, round(avg(confidence), 6) AS mean_confidence FROM a GROUP BY kind",
    cards=False,
)
def edge_kind_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = proposed(spark, sf_dir).filter(F.col("kind").isin(*KINDS) & (F.col("src") != F.col("dst")))
    c = {k: F.col(k) for k in ("kind", "confidence", "rationale", "source")}
    return a.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(evidence_gap(**c)).alias("gaps"), F.count_if(from_test(F.col("source"))).alias("test_origin"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))

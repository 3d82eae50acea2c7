"""Review queues: clients of the shop stand for questions, their changes for revisions, and a client's master for what it may repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import queues
from ..sources.cards import table
from .registry import register


def content(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(questions, revisions, changes with their client's workspace and the current revision of its master). Repeated changes are one."""
    changes = table(spark, sf_dir, "client_changes").select("change_id", "client_id", "seq", "op", "segment", "city", "source").filter("change_id IS NOT NULL AND client_id IS NOT NULL").distinct()
    latest = changes.groupBy("client_id").agg(F.max_by("change_id", F.struct(F.coalesce("seq", F.lit(-1)), "change_id")).alias("current"))
    clients = table(spark, sf_dir, "clients").select("client_id", "master_id", F.concat(F.lit("w"), F.col("nation_id") % 2).alias("workspace"))
    key = F.concat(F.lit("question.c"), "client_id")
    kind = F.when(F.col("client_id") % 7 == 0, "fixture").otherwise("production")
    questions = clients.join(latest, "client_id").select(key.alias("stable_key"), "workspace", kind.alias("content_kind"), F.col("current").alias("revision_id"))
    master = latest.select(F.col("client_id").alias("master_id"), F.col("current").alias("other"))
    own = clients.join(master, "master_id", "left")
    return questions, changes.select(F.col("change_id").alias("revision_id"), key.alias("stable_key")), changes.join(own, "client_id")


_CONTENT = """WITH ch AS (SELECT DISTINCT change_id, client_id, seq, op, segment, city, source FROM client_changes WHERE change_id IS NOT NULL AND client_id IS NOT NULL),
    la AS (SELECT client_id, change_id AS cur FROM (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY coalesce(seq, -1) DESC, change_id DESC) AS r FROM ch) WHERE r = 1),
    p AS (SELECT ch.*, 'w' || (c.nation_id % 2) AS workspace, c.master_id, m.cur AS other, l.cur AS own FROM ch JOIN clients c ON c.client_id = ch.client_id JOIN la l ON l.client_id = ch.client_id LEFT JOIN la m ON m.client_id = c.master_id)"""


@register(
    f"""{_CONTENT} SELECT change_id, 'question.c' || client_id AS left_key, 'question.c' || master_id AS right_key, CASE WHEN segment = 'retail' THEN 1.0::DOUBLE ELSE 0 END AS exact_score FROM p
    WHERE workspace = 'w1' AND op <> 'D' AND client_id % 7 <> 0 AND master_id % 7 <> 0 AND client_id <> master_id AND change_id = own AND other IS NOT NULL""",
    cards=False,
)
def duplicate_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open candidates of one workspace: every change is taken for a candidate with its client's master; those of changes that aren't current any more are left out."""
    questions, _, p = content(spark, sf_dir)
    scores = F.when(F.col("segment") == "retail", 1.0).alias("exact_score"), F.lit(None).cast("double").alias("semantic_score")
    decision = F.when(F.col("op") == "D", "not_duplicate").when(F.col("op").isNotNull(), "open").alias("decision")
    found = p.filter("client_id <> master_id").select("workspace", F.col("change_id").alias("left_revision"), F.col("other").alias("right_revision"), *scores, decision)
    return queues.duplicates(found, questions, "w1", "proposed").select(F.col("left_revision").alias("change_id"), "left_key", "right_key", "exact_score")


@register(
    f"""{_CONTENT} SELECT change_id, 'question.c' || client_id AS from_key, 'question.c' || master_id AS to_key, segment AS kind FROM p WHERE workspace = 'w0' AND op = 'I' AND client_id <> master_id AND other IS NOT NULL""",
    cards=False,
)
def edge_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposed edges of one workspace from every change's question to that of its master, current or not."""
    _, revisions, p = content(spark, sf_dir)
    status = F.when(F.col("op") == "I", "proposed").when(F.col("op") == "U", "accepted").otherwise("rejected").alias("status")
    found = p.filter("client_id <> master_id").select("workspace", F.col("change_id").alias("from_revision"), F.col("other").alias("to_revision"), F.col("segment").alias("kind"), status)
    return queues.edges(found, revisions, "w0", "proposed").select(F.col("from_revision").alias("change_id"), "from_key", "to_key", "kind")


@register(
    f"""{_CONTENT} SELECT change_id, 'question.c' || client_id AS stable_key, city AS capability_key, coalesce('{{"source":"' || source || '"}}', '{{}}') AS evidence FROM p WHERE workspace = 'w1' AND op = 'U'""",
    cards=False,
)
def binding_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposed bindings of one workspace: updates, with their source for evidence."""
    _, revisions, p = content(spark, sf_dir)
    status = F.when(F.col("op") == "U", "proposed").otherwise("accepted").alias("status")
    evidence = F.when(F.col("source").isNotNull(), F.to_json(F.struct("source"))).alias("evidence")
    found = p.select("workspace", F.col("change_id").alias("revision_id"), F.col("city").alias("capability_key"), evidence, status, F.lit(None).cast("string").alias("decided_by"))
    return queues.bindings(found, revisions, "w1").select(F.col("revision_id").alias("change_id"), "stable_key", "capability_key", "evidence")

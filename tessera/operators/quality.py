"""One quality report of a workspace's published questions: states of placement, counters of tasks and locales, groups of equal prompts, decisions, warnings.

questions   stable_key, revision_id, prompt, codes array<string> (of the gate), payload (JSON text or null)
locales     revision_id, locale
vectors     revision_id, locale
placed      stable_key
placements  revision_id, decision
pairs       a, b (keys, ordered), decision
outbox      published_at

Everything is grouped by a key before it is joined, so that no question becomes more than one row; the report is one row of counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import blank
from . import review

STATES = ("released", "accepted-pending", "proposed", "unplaced")


def placement_states(questions: DataFrame, placed: DataFrame, placements: DataFrame) -> DataFrame:
    """questions with ``placement``: released where they have a topic, else by the best decision over their current revision."""
    topics = placed.select("stable_key", F.lit(True).alias("_placed")).distinct()
    told = placements.groupBy("revision_id").agg(*[F.bool_or(F.col("decision") == d).alias(f"_{d}") for d in ("accepted", "proposed")])
    state = F.when(F.col("_placed"), STATES[0]).when(F.col("_accepted"), STATES[1]).when(F.col("_proposed"), STATES[2]).otherwise(STATES[3])
    return questions.join(topics, "stable_key", "left").join(told, "revision_id", "left").withColumn("placement", state).drop("_placed", "_accepted", "_proposed")


def locale_counts(locales: DataFrame, vectors: DataFrame) -> DataFrame:
    """revision_id, en, ru (there or not), bare: locales without a vector."""
    own = locales.select("revision_id", "locale").distinct().join(vectors.select("revision_id", "locale", F.lit(True).alias("_v")).distinct(), ["revision_id", "locale"], "left")
    return own.groupBy("revision_id").agg(F.bool_or(F.col("locale") == "en").alias("en"), F.bool_or(F.col("locale") == "ru").alias("ru"), F.count_if(F.col("_v").isNull()).alias("bare"))


def task_counters(payload: Column, contract: str = "task-brief.v1") -> list[Column]:
    """Aggregates over payloads: tasks, those that name a family, those that hold their solution, and those of the contract that do."""
    part = lambda k: F.get_json_object(payload, f"$.task{k}")
    there = F.coalesce(part("").startswith("{"), F.lit(False))
    solved = there & ~blank(part(".solution"))
    counts = ((there, "tasks"), (there & ~blank(part(".task_family_key")), "task_families"), (solved, "embedded_solutions"), (solved & (part(".contract_version") == contract), "boundary_violations"))
    return [F.count_if(c).alias(name) for c, name in counts]


def buckets(rows: DataFrame, key: str, name: str) -> DataFrame:
    """One row: array<struct<key, n>> of a column of few values, the most frequent first, then by name; blank ones are ``unclassified``. Empty without rows."""
    value = F.coalesce(F.nullif(F.trim(F.col(key)), F.lit("")), F.lit("unclassified")).alias("key")
    n = rows.select(value).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "key", "n"))), lambda x: x.dropFields("o")).alias(name))


def report(questions: DataFrame, locales: DataFrame, vectors: DataFrame, placed: DataFrame, placements: DataFrame, pairs: DataFrame, outbox: DataFrame) -> DataFrame:
    """One row; an empty table gives zeros, empty lists and no warnings. A warning is told by its code, in a fixed order."""
    per = placement_states(questions, placed, placements).join(locale_counts(locales, vectors), "revision_id", "left")
    no = lambda c: F.count_if(~F.coalesce(F.col(c), F.lit(False)))
    one = per.agg(
        F.count(F.lit(1)).alias("published"), *[F.count_if(F.col("placement") == s).alias(s.replace("-", "_")) for s in STATES], no("en").alias("missing_en"), no("ru").alias("missing_ru"),
        F.coalesce(F.sum("bare"), F.lit(0)).alias("bare_locales"), F.count_if(F.size("codes") > 0).alias("degenerate"), *task_counters(F.col("payload")),
    )
    groups = review.duplicate_groups(questions.select(F.col("stable_key").alias("key"), "prompt"), pairs)
    groups = groups.agg(F.count_if(~F.col("resolved")).alias("open_groups"), F.count_if("resolved").alias("resolved_groups"))
    own = pairs.join(questions.select(F.col("stable_key").alias("a")), "a", "left_semi")
    waiting = outbox.agg(F.count_if(F.col("published_at").isNull()).alias("outbox_pending"))
    out = one.join(groups).join(buckets(own, "decision", "decisions")).join(waiting)  # rows of one
    warnings = (
        ("placement_debt", F.col("released") < F.col("published")),
        ("missing_russian", F.col("missing_ru") > 0),
        ("degenerate_prompts", F.col("degenerate") > 0),
        ("open_duplicate_groups", F.col("open_groups") > 0),
        ("outbox_lag", F.col("outbox_pending") > 0),
        ("missing_vectors", F.col("bare_locales") > 0),
        ("task_boundary", F.col("boundary_violations") > 0),
    )
    return out.withColumn("warnings", F.array_compact(F.array(*[F.when(c, F.lit(code)) for code, c in warnings])))

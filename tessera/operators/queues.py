"""Review queues: what waits for a decision, read beside the content that it is about.

questions  stable_key, workspace, content_kind, revision_id (the current one)
revisions  revision_id, stable_key (all of them)

Proposals are joined with revisions by their id, which is unique, so that no key of a join is hot however many revisions a question has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DUPLICATE_STATES = ("open", "keep_separate", "merge", "not_duplicate")


def asked(proposals: DataFrame, workspace: str, status: str) -> DataFrame:
    """The proposals of a workspace in a state; with an empty state all."""
    if not workspace.strip():
        raise ValueError("a workspace is required")
    out = proposals.filter(F.col("workspace") == workspace.strip())
    return out.filter(F.col("status") == status.strip()) if status.strip() else out


def keyed(proposals: DataFrame, revisions: DataFrame, side: str) -> DataFrame:
    """proposals with ``<side>_key``, the question of ``<side>_revision``. A proposal of a revision that isn't there is left out."""
    return proposals.join(revisions.select(F.col("revision_id").alias(f"{side}_revision"), F.col("stable_key").alias(f"{side}_key")), f"{side}_revision")


def duplicates(candidates: DataFrame, questions: DataFrame, workspace: str, status: str = "") -> DataFrame:
    """candidates (workspace, left_revision, right_revision, exact_score, semantic_score, decision, more) in a state, both of whose revisions are the current ones of production questions.

    No state, or ``proposed``, asks for open ones. Scores that weren't made are 0. An unknown state is an error.
    """
    status = status.strip().lower()
    status = "open" if status in ("", "proposed") else status
    if status not in DUPLICATE_STATES:
        raise ValueError(f"no such state of a duplicate: {status}")
    current = questions.filter("content_kind = 'production'").select("revision_id", "stable_key")
    out = asked(candidates.withColumnRenamed("decision", "status"), workspace, status)
    out = keyed(keyed(out, current, "left"), current, "right")
    return out.withColumnRenamed("status", "decision").fillna(0.0, ["exact_score", "semantic_score"])


def edges(proposals: DataFrame, revisions: DataFrame, workspace: str, status: str = "") -> DataFrame:
    """proposals (workspace, from_revision, to_revision, kind, status, more) with the questions of both ends, current or not; no state asks for all."""
    return keyed(keyed(asked(proposals, workspace, status), revisions, "from"), revisions, "to")


def bindings(proposals: DataFrame, revisions: DataFrame, workspace: str, status: str = "") -> DataFrame:
    """proposals (workspace, revision_id, capability_key, evidence, status, decided_by, more) with their questions; no state asks for proposed ones. No evidence is an empty object."""
    out = asked(proposals, workspace, status.strip() or "proposed").join(revisions.select("revision_id", "stable_key"), "revision_id")
    return out.fillna({"evidence": "{}", "decided_by": ""})

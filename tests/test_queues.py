"""Review queues on small cases: states, revisions that aren't current, errors and nothing at all."""

import pytest

from tessera.operators import queues

QUESTIONS = [("a", "w", "production", "r2"), ("b", "w", "production", "r3"), ("f", "w", "fixture", "r4")]
REVISIONS = [("r1", "a"), ("r2", "a"), ("r3", "b"), ("r4", "f")]
CANDIDATES = [("w", "r2", "r3", 1.0, None, "open"), ("w", "r1", "r3", 1.0, None, "open"), ("w", "r2", "r4", 1.0, 0.9, "open"), ("w", "r3", "r2", None, 0.8, "merge"), ("v", "r2", "r3", 1.0, None, "open"), ("w", "r2", "r3", 1.0, None, None)]


@pytest.fixture(scope="module")
def tables(spark):
    q = spark.createDataFrame(QUESTIONS, "stable_key string, workspace string, content_kind string, revision_id string")
    c = spark.createDataFrame(CANDIDATES, "workspace string, left_revision string, right_revision string, exact_score double, semantic_score double, decision string")
    return q, spark.createDataFrame(REVISIONS, "revision_id string, stable_key string"), c


@pytest.mark.parametrize("status", ["", "proposed", " Open "])
def test_open_pairs_of_current_production_questions(tables, status):
    q, _, c = tables
    rows = queues.duplicates(c, q, " w ", status).collect()
    assert [(r.left_key, r.right_key, r.exact_score, r.semantic_score) for r in rows] == [("a", "b", 1.0, 0.0)]


def test_decided_pairs_and_errors(tables):
    q, _, c = tables
    assert [(r.left_key, r.exact_score, r.decision) for r in queues.duplicates(c, q, "w", "merge").collect()] == [("b", 0.0, "merge")]
    assert queues.duplicates(c.limit(0), q, "w").count() == 0
    with pytest.raises(ValueError, match="no such state"):
        queues.duplicates(c, q, "w", "later")
    with pytest.raises(ValueError, match="workspace"):
        queues.duplicates(c, q, " ")


def test_edges_and_bindings(spark, tables):
    _, revisions, _ = tables
    e = spark.createDataFrame([("w", "r1", "r3", "related", "proposed"), ("w", "r4", "r2", "related", "accepted"), ("w", "r9", "r2", "related", "proposed")], "workspace string, from_revision string, to_revision string, kind string, status string")
    assert [(r.from_key, r.to_key) for r in queues.edges(e, revisions, "w", "proposed").collect()] == [("a", "b")]
    assert {(r.from_key, r.to_key) for r in queues.edges(e, revisions, "w").collect()} == {("a", "b"), ("f", "a")}
    b = spark.createDataFrame([("w", "r1", "c1", None, "proposed", None), ("w", "r2", "c1", "{}", "accepted", "x")], "workspace string, revision_id string, capability_key string, evidence string, status string, decided_by string")
    assert [(r.stable_key, r.evidence, r.decided_by) for r in queues.bindings(b, revisions, "w").collect()] == [("a", "{}", "")]

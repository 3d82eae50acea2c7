"""The quality report on small tables, with nothing, and with every warning."""

from tessera.operators import quality


def tables(spark, some: bool):
    t = lambda rows, schema: spark.createDataFrame(rows if some else [], schema)
    task = '{"task": {"task_family_key": " ", "contract_version": "task-brief.v1", "solution": "x"}}'
    q = [("a", "r1", "p", [], task), ("b", "r2", "p", ["empty_prompt"], '{"task": "text"}'), ("c", "r3", "z", [], None), ("d", "r4", "z", [], '{"task": {"solution": " ", "task_family_key": "k"}}'), ("e", "r5", "", [], "no json")]
    return (
        t(q, "stable_key string, revision_id string, prompt string, codes array<string>, payload string"),
        t([("r1", "en"), ("r1", "ru"), ("r2", "ru"), ("r2", "ru"), ("r9", "de")], "revision_id string, locale string"),
        t([("r1", "en"), ("r1", "en")], "revision_id string, locale string"),
        t([("a",), ("a",)], "stable_key string"),
        t([("r1", "proposed"), ("r2", "accepted"), ("r2", "proposed"), ("r3", "proposed"), ("r4", "rejected")], "revision_id string, decision string"),
        t([("a", "b", "open"), ("c", "d", "merge"), ("x", "y", "merge")], "a string, b string, decision string"),
        t([(None,), (1,)], "published_at long"),
    )


def test_report(spark):
    r = quality.report(*tables(spark, True)).collect()[0].asDict(recursive=True)
    assert [r[s.replace("-", "_")] for s in quality.STATES] == [1, 1, 1, 2]
    assert (r["published"], r["missing_en"], r["missing_ru"], r["bare_locales"], r["degenerate"]) == (5, 4, 3, 2, 1)
    assert (r["tasks"], r["task_families"], r["embedded_solutions"], r["boundary_violations"]) == (2, 1, 1, 1)
    assert (r["open_groups"], r["resolved_groups"], r["outbox_pending"]) == (1, 1, 1)
    assert r["decisions"] == [{"key": "merge", "n": 1}, {"key": "open", "n": 1}]
    assert r["warnings"] == ["placement_debt", "missing_russian", "degenerate_prompts", "open_duplicate_groups", "outbox_lag", "missing_vectors", "task_boundary"]


def test_of_nothing(spark):
    r = quality.report(*tables(spark, False)).collect()[0].asDict()
    assert r.pop("warnings") == [] and r.pop("decisions") == []
    assert set(r.values()) == {0}

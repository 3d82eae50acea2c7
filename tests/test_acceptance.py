"""A batch with a copy, a near vector, a malformed card and one of its own; and an empty one."""

import pytest

from tessera.operators import acceptance, imports
from tessera.plans.review import similar_pairs
from tessera.sources.scratch import Scratch

TEXT = "struct<prompt:string,short_answer:string,explanation:string>"
BATCH = f"stage_id long, source_ref string, stable_key string, content_hash string, problems array<string>, en {TEXT}, ru {TEXT}, body_hash string, prompt string, vector array<double>, label long"
CURRENT = "stable_key string, body_hash string, prompt string, vector array<double>, label long"


def card(i, body, prompt, vector, label, *problems):
    return (i, f"{i}.md", f"n{i}", f"h{i}", list(problems), (prompt, "a", None), (None, None, None), body, prompt, vector, label)


ROWS = [card(1, "same", "what is a lock", [1.0, 0.0], 1), card(2, "b2", "zeta seven", [0.0, 1.0], 2), card(3, "b3", "omega nine", [-1.0, 0.0], None), card(4, "same", "bad", [1.0, 0.0], 1, "short")]
PUBLISHED = [("a", "same", "what is a lock", [1.0, 0.0], 1), ("b", "b9", "alpha", [0.1, 1.0], 2), ("c", "b8", "beta", [0.2, 1.0], 1)]


def accepted(spark, rows):
    scratch = Scratch(spark, "acceptance")
    return acceptance.accept(imports.empty(spark), spark.createDataFrame(rows, BATCH), spark.createDataFrame(PUBLISHED, CURRENT), similar_pairs, scratch.write).collect()[0].asDict()


def test_batch(spark):
    r = accepted(spark, ROWS)
    assert (r["first_files"], r["first_invalid"], r["retry_invalid"], r["retry_unchanged"]) == (4, 1, 1, 3)
    assert (r["exact"], r["semantic"], r["stages"], r["open_stages"], r["blocked"]) == (1, 2, 3, 2, 2)
    # pairs of equal labels: the first card with a and c, the second with b
    assert (r["right"], r["equal"], r["precision"]) == (1, 3, 0.5)
    assert r["recall"] == pytest.approx(1 / 3) and r["failed"] == []


def test_empty_batch(spark):
    r = accepted(spark, [])
    assert r["failed"] == ["exact", "semantic", "open_stages"] and (r["precision"], r["recall"], r["first_files"]) == (1.0, 1.0, 0)


def test_candidates_of_prompts_with_many_copies(spark):
    """Of 60 published cards of one prompt the 25 with the smallest keys are candidates, whatever the stage's own card and body take away; prompts meet once."""
    from tessera.operators import review

    card = lambda i: (f"k{i:02}", "same" if i < 10 else f"b{i}", "one prompt of many cards", [1.0, 0.0])
    current = spark.createDataFrame([card(i) for i in range(60)], "stable_key string, body_hash string, prompt string, vector array<double>")
    stages = spark.createDataFrame([(1, "k03", "same", "one prompt of many cards", None), (2, "k20", "new", "one prompt of many cards", None)], "stage_id long, " + "stable_key string, body_hash string, prompt string, vector array<double>")
    asked = []

    def similar(left, right, threshold):
        asked.append((left.count(), right.count()))
        return similar_pairs(left, right, threshold)

    got = {}
    for r in review.import_candidates(stages, current, similar).collect():
        got.setdefault((r.stage_id, r.candidate_type), set()).add(r.related_key)
    assert asked == [(1, 1)]
    assert got[1, "exact_duplicate"] == {f"k{i:02}" for i in range(10) if i != 3}
    assert got[1, "lexical_neighbor"] == {f"k{i:02}" for i in range(10, 35)}
    assert got[2, "lexical_neighbor"] == {f"k{i:02}" for i in range(26) if i != 20}

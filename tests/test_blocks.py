"""Pairs found block by block against plain loops, with blocks and tables so small that all their edges occur."""

import random

import pytest

from tessera.operators import blocks
from tessera.operators.blocks import nearest_of_groups, nearest_pairs
from tessera.plans.review import similar_pairs


def grams(text):
    return {w[i : i + 3] for w in (f"  {w} " for w in text.split()) for i in range(len(w) - 2)}


def plain(left, right, t, itself):
    out = {}
    for a, x in left:
        for b, y in right:
            x_, y_ = grams(x), grams(y)
            if (not itself or a < b) and x_ and y_ and len(x_ & y_) / len(x_ | y_) >= t:
                out[a, b] = round(len(x_ & y_) / len(x_ | y_), 9)
    return out


def prompts(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcдé", k=rng.randint(1, 4))) for _ in range(60)]
    out = [" ".join(rng.choices(words, k=rng.choice((1, 2, 3, 8, 20, 60)))) for _ in range(n)]
    return list(enumerate(out[: n // 2] + [p + " " + rng.choice(words) for p in out[: n // 2]] + ["", " "]))


@pytest.mark.parametrize("block", [16_384, 40])
def test_similar_prompts(spark, monkeypatch, block):
    monkeypatch.setattr(blocks, "BLOCK", block)
    left, right = prompts(100, 1), prompts(60, 1)
    x, y = (spark.createDataFrame(p, "key long, prompt string") for p in (left, right))
    found = lambda df: {(r.a, r.b): round(r.similarity, 9) for r in df.collect()}
    for t in (0.55, 0.8):
        assert found(similar_pairs(x, x, t, itself=True)) == plain(left, left, t, True)
        assert found(similar_pairs(x, y, t)) == plain(left, right, t, False)
    assert similar_pairs(x, y.limit(0), 0.5).count() == 0


def test_candidates_that_are_no_pairs_are_no_rows(spark):
    """All prompts share most trigrams, so that every pair was a row of a shuffle before; now no stage between the blocks and the result has more rows than the result."""
    rng = random.Random(3)
    p = [(i, " ".join(rng.sample([a + b for a in "abcdefgh" for b in "abcdefgh"], 24))) for i in range(300)]
    out = similar_pairs(spark.createDataFrame(p, "key long, prompt string"), spark.createDataFrame(p, "key long, prompt string"), 0.55, itself=True)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    assert {(r.a, r.b) for r in out.collect()} == set(plain(p, p, 0.55, True))


@pytest.mark.parametrize("block", [16_384, 11])
def test_nearest(spark, monkeypatch, block):
    monkeypatch.setattr(blocks, "BLOCK", block)
    rng = random.Random(5)
    v = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(60)]
    v += [(60 + i, v[0][1]) for i in range(30)] + [(90, [0.0] * 6), (91, None), (92, [1.0, 2.0]), (93, [1.0, None, 0.0, 0.0, 0.0, 0.0])]
    norm = lambda x: sum(e * e for e in x) ** 0.5
    cos = lambda x, y: sum(a * b for a, b in zip(x, y, strict=True)) / norm(x) / norm(y)
    good = [(i, x) for i, x in v if x and None not in x and norm(x)]
    pairs = {(i, j): cos(x, y) for i, x in good for j, y in good if len(x) == len(y)}
    e = spark.createDataFrame(v, "id long, v array<double>")
    q, c = e.selectExpr("id AS q", "v"), e.selectExpr("id AS other", "v AS w")
    assert {(r.q, r.other): round(r.similarity, 9) for r in nearest_pairs(q, c, 0.3).collect()} == {k: round(s, 9) for k, s in pairs.items() if s >= 0.3}
    got = {}
    for r in nearest_pairs(q, c, 0.0, ("q", "other"), 4, "other").collect():
        got.setdefault(r.q, []).append((-round(r.similarity, 9), r.other))
    for i, _ in good:
        want = sorted((-round(s, 9), k[1]) for k, s in pairs.items() if k[0] == i and k[1] != i and s >= 0)[:4]
        assert [(round(s, 8), j) for s, j in sorted(got.get(i, []))[:4]] == [(round(s, 8), j) for s, j in want]
    best = {}
    for r in nearest_of_groups(e.selectExpr("id % 3 AS g", "v"), c, "g", 0.1).collect():
        best[r.g, r.other] = max(best.get((r.g, r.other), 0), round(r.similarity, 8))
    want = {}
    for (i, j), s in pairs.items():
        if s >= 0.1:
            want[i % 3, j] = max(want.get((i % 3, j), 0), round(s, 8))
    assert best == want

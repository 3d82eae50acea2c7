"""Operators 6 and 10 on tables whose rows share ids or have none, against brute force for every row."""

import collections
import hashlib
import random

import pytest


def word(rng):
    return "".join(rng.choice("abcdefghij") for _ in range(6))


def text(seed, n=120):
    rng = random.Random(seed)
    return " ".join(word(rng) for _ in range(n))


P, Q = text("p"), text("q")
#: Ids that are shared, null ids, repeated rows, extremes of long, an empty and a null text.
ROWS = [(None, P), (None, text("x")), (9, P), (11, text("z")), (11, P), (11, P), (None, Q), (None, Q), (12, text("y") + " " + Q), (None, None), (13, None), (13, ""), (2**63 - 1, P + " " + text("w")), (-(2**63), text("v") + " " + Q), (14, text("u") * 2), (15, "  " + P.replace(" ", "\n")), (15, P)]


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(i, t, 1) for i, t in ROWS], "doc_id long, text string, key int").repartition(3)


@pytest.mark.parametrize("hot", [0, 100_000])
def test_substring(spark, table, hot, monkeypatch):
    from tessera.llm import substring_dedup as op

    real = op.substring_dedup
    monkeypatch.setattr(op, "substring_dedup", lambda spark, docs, window: real(spark, docs, window, hot))
    got = collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in op.substring_report(spark, table).collect())
    spread = spark.createDataFrame(set(ROWS), "doc_id long, text string")
    order = {(r.doc_id, r.text): (r.doc_id is not None, r.doc_id or 0, r.k) for r in spread.selectExpr("doc_id", "text", "xxhash64(coalesce(text, '')) | 1 AS k").collect()}
    seen, out = set(), {}
    for row in sorted(set(ROWS), key=lambda r: order[r]):
        w = (row[1] or "").split()
        cover = [False] * len(w)
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            if key in seen:
                cover[k : k + 20] = [True] * 20
            seen.add(key)
        out[row] = (len(w), sum(cover), sha(" ".join(x for x, c in zip(w, cover) if not c)))
    assert got == collections.Counter((r[0], *out[r]) for r in ROWS)
    assert out[11, P][1] == 120 and out[9, P][1] == 120 and out[11, text("z")][1] == 0 and out[None, text("x")][1] == 0


def test_suffix(spark, table):
    from tessera.llm.suffix_dedup import suffix_report

    got = collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_report(spark, table).collect())
    docs = {r: (r[1] or "").encode() for r in set(ROWS)}
    count = collections.Counter(t[k : k + 400] for t in docs.values() for k in range(len(t) - 399))
    out = {}
    for row, t in docs.items():
        cover = bytearray(len(t))
        for k in range(len(t) - 399):
            if count[t[k : k + 400]] > 1:
                cover[k : k + 400] = b"\1" * 400
        out[row] = (len(t), sum(cover), sum(cover[k] and (not k or not cover[k - 1]) for k in range(len(t))), sha(bytes(x for x, c in zip(t, cover) if not c)))
    assert got == collections.Counter((r[0], *out[r]) for r in ROWS)
    assert out[11, text("z")][1] == 0 and out[None, text("x")][1] == 0 and out[11, P][1] > 0

"""Operator 13 against a brute-force version, and exact round trips."""

import hashlib
import re

import pytest

from tessera.llm import fill_in_middle as fim

TEXTS = ["", None, "one line", "one\n", "\n", "\n\n\n", "a\nb\nc", "x\r\ny\n", "  lead\n trail \n", "häß\n漢字\n😀😀\nend", "has <P> in it\nb", "<S>", "a<\nP>\nM>", "<M", "tail <P\n", "v\x0bw\x85 z\nq", "z" * 70000 + "\n" + "y\n" * 3000]


def brute(doc_id, text, pattern, rate=100, spm=50):
    text = text or ""
    u = re.findall(pattern, text)
    assert "".join(u) == text
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(u)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in fim.MARKERS) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    return (n, "spm", p, m, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < spm else (n, "psm", p, m, f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("name", sorted(fim.GRAMMARS))
def test_against_brute_force(spark, name):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + i, t) for i, t in enumerate(TEXTS)] + [(None, "null\nid\n"), (3, "same\nid"), (2, TEXTS[2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'x' AS form", "1 AS units", "2 AS digits")
    grammar = fim.GRAMMARS[name]
    got = sorted(((r.doc_id, r.n, r.form, r.prefix, r.middle, r.output, r.back) for r in fim.fill_in_middle(docs, grammar).withColumn("back", fim.restored(fim.F.col("output"), fim.F.col("form"))).collect()), key=str)
    want = sorted(((i, *brute(i, t, grammar.pattern), t or "") for i, t in rows), key=str)
    assert got == want
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_rate_and_order(spark):
    rows = [(i, f"a{i}\nb\nc\n") for i in range(400)]
    got = fim.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"), rate=30, spm=10).collect()
    assert sorted((r.doc_id, r.n, r.form, r.prefix, r.middle, r.output) for r in got) == sorted((i, *brute(i, t, fim.GRAMMARS["lines"].pattern, 30, 10)) for i, t in rows)


def test_report_of_empty_table(spark):
    out = fim.fill_in_middle_report(spark.createDataFrame([], "doc_id long, text string"))
    assert out.dtypes == [("doc_id", "bigint"), ("n", "bigint"), ("form", "string"), ("prefix_chars", "bigint"), ("middle_chars", "bigint"), ("output_sha256", "string"), ("restored_sha256", "string")]
    assert out.count() == 0


def test_markers_that_may_overlap(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for bad in (("<P>", "<P>", "<M>"), ("ab", "ba", "cc"), ("", "<S>", "<M>"), ("<PP>", "PP", "<M>")):
        with pytest.raises(ValueError):
            fim.fill_in_middle(docs, markers=bad)

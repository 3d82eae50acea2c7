"""The pipeline and its stages against brute force, on repeated ids, nulls, extra columns, long texts and empty tables."""

import random

import pytest

import corpus_pipeline

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
rng = random.Random(11)
WORDS = [f"w{k}" for k in range(900)]


def text(n):
    return " ".join(rng.choices(WORDS, k=n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    base = [text(60) for _ in range(30)]
    item = text(30)
    near = base[3].split()
    near[20] = "other"
    rows = [(k, t) for k, t in enumerate(base)]
    rows += [(100, base[0]), (5, base[0]), (101, base[1].replace(" ", "  ")), (102, " ".join(near)), (103, f"{text(10)} {item} {text(10)}"), (None, base[2]), (None, text(40)), (104, None), (105, ""), (106, "badword " * 5 + text(20)), (107, text(60_000))]
    rows += [(200 + k, f"badword badword {text(25)}") for k in range(40)] + [(300 + k, text(30)) for k in range(40)]
    spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], COLUMNS).write.parquet(str(d / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(d / "benchmark.parquet"))
    spark.createDataFrame([(200 + k, 1, 1) for k in range(30)] + [(300 + k, 1, 0) for k in range(30)] + [(k, 1, 0) for k in range(30)], "doc_id long, quality int, toxic int").write.parquet(str(d / "labels.parquet"))
    return str(d), rows, item


def test_stages(spark, folder):
    d, rows, item = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    kept = stage["toxicity"](spark, docs, d)
    assert kept.columns == docs.columns
    left = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted(left, key=str) == sorted([r for r in rows if "badword" not in (r[1] or "")], key=str)
    # of texts that are equal but for white space the smallest id stays; (5, base[0]) goes and (5, base[5]) does not
    norm = lambda t: " ".join((t or "").split())
    want = {}
    for i, t in left:
        key = (i is None, i or 0)
        if norm(t) not in want or key < want[norm(t)][0]:
            want[norm(t)] = (key, (i, t))
    exact = stage["exact_dedup"](spark, kept, d)
    assert sorted(map(str, ((r.doc_id, r.text) for r in exact.collect()))) == sorted(str(v) for _, v in want.values())
    near = stage["near_dedup"](spark, exact, d)
    ids = {r.doc_id for r in near.collect()}
    assert 3 in ids and 102 not in ids and near.count() == exact.count() - 1
    clean = stage["decontamination"](spark, near, d)
    assert {r.doc_id for r in near.collect()} - {r.doc_id for r in clean.collect()} == {103}
    packed = stage["packing"](spark, clean, d).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in clean.collect()}
    long_ = sorted(((r.start, r.length) for r in packed if r.doc_id == 107))
    assert sum(n for _, n in long_) == next(r.doc_tokens for r in packed if r.doc_id == 107) and all(a + n == b for (a, n), (b, _) in zip(long_, long_[1:]))


def test_run_equals_its_stages(spark, folder):
    d = folder[0]
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, d)
    key = lambda r: (r.doc_id or -1, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, corpus_pipeline.run(spark, d).collect())) == sorted(map(key, docs.collect()))


def test_empty_tables(spark, folder, tmp_path):
    for name, schema in (("documents", COLUMNS), ("benchmark", "item_id long, text string"), ("labels", "doc_id long, quality int, toxic int")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clashing_columns(spark, folder):
    d = folder[0]
    docs = spark.read.parquet(f"{d}/documents.parquet").selectExpr("doc_id", "text", "lang AS n", "source AS stays", "n_chars AS `grp`")
    for name in ("toxicity", "exact_dedup", "near_dedup", "decontamination"):
        out = dict(corpus_pipeline.STAGES)[name](spark, docs, d)
        assert out.columns == docs.columns and out.filter("doc_id = 7 and n = 'en'").count() == 1


def test_long_text_scores(spark):
    """One long text beside short ones: whole, and in room that follows its tokens."""
    from tessera.llm.gru import lay_out
    from tessera.llm.lm_scoring import score_documents

    import numpy as np

    y, owner, fresh, start, length = lay_out([np.arange(5), np.arange(100_000), np.arange(3)], 7, 64)
    assert len(y) == len(owner) == len(fresh) == 6 + 100_001 + 4 and fresh.sum() == 3 and length.tolist() == [100_001, 6, 4]
    docs = spark.createDataFrame([(k, text(20)) for k in range(40)] + [(99, text(30_000))], "doc_id long, text string")
    got = {r.doc_id: r for r in score_documents(spark, docs).collect()}
    assert len(got) == 41 and got[99].n_tokens == 30_001 and got[99].score < got[0].score < 0

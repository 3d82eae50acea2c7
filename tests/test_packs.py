"""Pairs of like trigram sets: what lies on disk, and packs with tiles and numbers so small that all their edges occur."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest

from tessera.operators import blocks
from tessera.plans.review import similar_pairs

from .test_blocks import grams, plain, prompts


def test_sets_are_shuffled_as_often_in_a_large_table(spark, monkeypatch):
    """Each set was shuffled once a block of the other side before, so that four times the sets were sixteen times the shuffle."""
    monkeypatch.setattr(blocks, "BLOCK", 50)
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(300)]

    def written():
        time.sleep(1)  # the figures come by an event
        return spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()

    def shuffled(n):
        df = spark.createDataFrame([(i, " ".join(rng.choices(words, k=20))) for i in range(n)], "key long, prompt string").coalesce(1)
        before = written()
        similar_pairs(df, df, 0.55, itself=True).count()
        return written() - before

    assert shuffled(2400) < 6 * shuffled(600)


@pytest.mark.parametrize("sample, short", [(2048, 65_535), (3, 65_535), (40, 30)])
def test_any_sample_gives_the_same_pairs(spark, monkeypatch, sample, short):
    """What the sample doesn't show, or has no short number, is compared as well."""
    for name, value in (("SAMPLE", sample), ("REST", short), ("OFTEN", 50), ("BLOCK", 30)):
        monkeypatch.setattr(blocks, name, value)
    left, right = prompts(80, 2), prompts(60, 2)
    x, y = (spark.createDataFrame(p, "key long, prompt string") for p in (left, right))
    found = lambda df: {(r.a, r.b): round(r.similarity, 9) for r in df.collect()}
    assert found(similar_pairs(x, x, 0.55, itself=True)) == plain(left, left, 0.55, True)
    assert found(similar_pairs(x, y, 0.3)) == plain(left, right, 0.3, False)


@pytest.mark.parametrize("strip, wide, lookups, span", [(256, 2048, 1 << 20, 0.85), (4, 8, 60, 0.1), (5, 10, 1, 3.0)])
def test_tiles_of_a_pack(monkeypatch, strip, wide, lookups, span):
    for name, value in (("STRIP", strip), ("WIDE", wide), ("LOOKUPS", lookups), ("SPAN", span), ("OFTEN", 40)):
        monkeypatch.setattr(blocks, name, value)
    p = [(k, t) for k, t in prompts(120, 4) if grams(t)]
    texts = pa.chunked_array([["".join(sorted(grams(t))) for _, t in p]])
    book = blocks.Book(texts)
    sets = pa.table({"key": pa.array([k for k, _ in p]), **book.written(texts)}).sort_by([("label", "ascending"), ("size", "ascending")])
    pack = blocks._pack(sets)
    room = np.empty(strip * wide, np.float32), np.empty(strip * wide, bool)
    for t in (0.2, 0.55, 0.9, 1.0):
        x = blocks._Opened(pack, "", 0, (1 - t) / (1 + t))
        keys = x.keys.to_pylist()
        for same in (True, False):
            y = blocks._Opened(pack, "", 0, (1 - t) / (1 + t))
            got = [(keys[a], keys[b], round(s, 9)) for i, j, sim in blocks._alike(x, y, t, same, room) for a, b, s in zip(i, j, sim, strict=True)]
            want = plain(p, p, t, False)
            if same:
                assert len({(min(a, b), max(a, b)) for a, b, _ in got}) == len(got)
                assert {(min(a, b), max(a, b)): s for a, b, s in got} == {k: s for k, s in want.items() if k[0] < k[1]}
            else:
                assert len(got) == len(want) and {(a, b): s for a, b, s in got} == want

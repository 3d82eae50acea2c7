"""The training-data operators against brute force on small tables with nulls, empty texts, ties, repeated rows and clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib
from functools import lru_cache

import pytest

random.seed(4)
W = [f"w{k}" for k in range(400)]
PASSAGE = " ".join(random.choices(W, k=130))


@lru_cache
def corpus():
    base = [" ".join(random.choices(W, k=random.choice([1, 2, 5, 30, 80, 300]))) for _ in range(25)]
    near = []
    for t in base[:8]:
        w = t.split()
        w[len(w) // 2] = "changed"
        near.append(" ".join(w))
    texts = [None, "", " \n", "a", "a b", *base, *base[:5], base[3].replace(" ", "  \t"), *near, f"{base[5]} {PASSAGE} x", f"y {PASSAGE} {base[6]}", "Nd, " * 400, "ab" * 700, 'token = "abcdefgh1" AKIA1234567890ABCD é ' + "0af9" * 10]
    rows = [(k, t, "en" if k % 3 else None, "s", 1) for k, t in enumerate(texts)]
    return [*rows, rows[9], (None, "nobody", "en", "s", 1)]


SCHEMA = "doc_id long, text string, h string, n string, runs int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows():
    """Text by id."""
    return {r[0]: (r[1] or "") for r in corpus() if r[0] is not None}


def test_exact(spark, docs, empty):
    from tessera.llm.exact_dedup import exact_dedup

    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = collections.defaultdict(list)
    for r in corpus():
        groups[norm(r[1])].append(r[0])
    for first, growth in ((4, 2), (256, 16)):
        got = exact_dedup(spark, docs, first, growth).collect()
        assert len(got) == len(corpus())
        by = {r.doc_id: r for r in got}
        for r in corpus():
            own = [x for x in groups[norm(r[1])] if x is not None]
            assert by[r[0]].keep_id == (min(own) if own else None) and by[r[0]].group_size == len(groups[norm(r[1])])
            assert by[r[0]].text_sha256 == hashlib.sha256(norm(r[1]).encode()).hexdigest()
    assert exact_dedup(spark, empty).count() == 0


def test_near(spark, docs, empty):
    from tessera.llm.minhash import near_duplicates

    sets = {}
    for i, t in rows().items():
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    got = {r.doc_id: r for r in near_duplicates(spark, docs, 3, 85).collect()}
    assert {i: (got[i].n_shingles, got[i].component_id) for i in sets} == {i: (len(sets[i]), find(i)) for i in sets}
    assert near_duplicates(spark, empty).count() == 0


def test_near_copies_of_unlike_closeness(spark):
    """One base with few to many words changed: most candidates aren't links, and links join them through others."""
    from tessera.llm.minhash import near_duplicates

    rng = random.Random(3)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for k in range(90):
        w = list(base)
        for j in rng.sample(range(len(w)), k % 9):
            w[j] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    sets = [{tuple(t.split()[k : k + 3]) for k in range(118)} for t in texts]
    want = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) and want[a] != want[b]:
                low, high = sorted((want[a], want[b]))
                want = [low if x == high else x for x in want]
    assert len(set(want)) > 5
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for block in (1024, 16):
        got = {r.doc_id: r.component_id for r in near_duplicates(spark, docs, 3, 85, block=block).collect()}
        assert [got[k] for k in range(len(texts))] == want


def test_components(spark):
    from tessera.llm.common import Scratch
    from tessera.llm.minhash import components

    e = spark.createDataFrame([(random.randrange(300), random.randrange(300, 600)) for _ in range(150)] + [(k, k + 1) for k in range(700, 760)], "a long, b long")
    one, many = (sorted(map(tuple, components(Scratch(spark, "t"), e, few).collect())) for few in (1000, 5))
    assert one == many


@pytest.mark.parametrize("hot", [0, 3, 100_000])
def test_substring(spark, docs, empty, hot, monkeypatch):
    from tessera.llm import substring_dedup

    substring_report, real = substring_dedup.substring_report, substring_dedup.substring_dedup
    monkeypatch.setattr(substring_dedup, "substring_dedup", lambda spark, docs, window: real(spark, docs, window, hot))

    seen, want = set(), {}
    for i, t in sorted(rows().items()):
        w = t.split()
        cover = [False] * len(w)
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            if key in seen:
                cover[k : k + 20] = [True] * 20
            seen.add(key)
        want[i] = (len(w), sum(cover), hashlib.sha256(" ".join(x for x, c in zip(w, cover) if not c).encode()).hexdigest())
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_report(spark, docs).collect() if r.doc_id is not None}
    assert got == want
    assert substring_report(spark, empty).count() == 0


@pytest.mark.parametrize("block", [0, 7])
def test_suffix(spark, docs, empty, block, monkeypatch):
    from tessera.llm import suffix_dedup

    if block:
        monkeypatch.setattr(suffix_dedup, "block_of", lambda n: 7)
    texts = {i: t.encode() for i, t in rows().items()}
    count = collections.Counter(t[k : k + 400] for t in texts.values() for k in range(len(t) - 399))
    want = {}
    for i, t in texts.items():
        cover = bytearray(len(t))
        for k in range(len(t) - 399):
            if count[t[k : k + 400]] > 1:
                cover[k : k + 400] = b"\1" * 400
        want[i] = (len(t), sum(cover), sum(cover[k] and (not k or not cover[k - 1]) for k in range(len(t))), hashlib.sha256(bytes(x for x, c in zip(t, cover) if not c)).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.suffix_report(spark, docs).collect() if r.doc_id is not None}
    assert got == want
    assert suffix_dedup.suffix_report(spark, empty).count() == 0


def test_packing(spark, docs, empty):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    from tessera.llm.packing import pack, shortest_pack_first

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    got = pack(spark, docs, path, limit=64).collect()
    for i, t in rows().items():
        ids = [*tok.encode(t, add_special_tokens=False).ids, 2]
        own = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got if r.doc_id == i)
        want = [(a, len(ids[a : a + 64]), zlib.crc32(np.array(ids[a : a + 64], "<u4").tobytes()), len(ids)) for a in range(0, len(ids), 64)]
        assert own == want or own == sorted(want * 2)
    for s in {r.sequence_id for r in got}:
        at = 0
        for r in sorted((r for r in got if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    assert pack(spark, empty, path).count() == 0
    packs = shortest_pack_first({5: 3, 3: 4, 2: 9}, 8)
    assert collections.Counter(n for p, c in packs for n in p * c) == {5: 3, 3: 4, 2: 9} and all(sum(p) <= 8 for p, _ in packs)


def test_packing_fill_with_a_hot_length():
    from tessera.llm.packing import placed, shortest_pack_first

    rng = random.Random(5)
    limit = 4096
    spread = collections.Counter(min(limit, max(1, int(rng.lognormvariate(5.5, 1)))) for _ in range(20000))
    for hot in (1, 60, 150, 600, 1000):
        for base in (spread, collections.Counter()):
            histogram = base + collections.Counter({hot: 10001})
            packs = shortest_pack_first(histogram, limit)
            assert all(sum(p) <= limit for p, _ in packs)
            assert sum((collections.Counter({n: c}) for p, c in packs for n in p), collections.Counter()) == histogram
            total = sum(n * c for n, c in histogram.items())
            best = -(-10001 // (limit // hot)) if not base else total / limit / 0.98
            assert sum(c for _, c in packs) <= best
            # each rank of a length has one slot
            slots = placed(packs)
            assert len({*zip(slots["length"].tolist(), slots["rank"].tolist())}) == len(slots["rank"])


def test_secrets(spark, docs, empty):
    from tessera.llm.secrets import secret_report

    a = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    for r in secret_report(spark, docs).collect():
        t = rows().get(r.doc_id, "")
        want = [(m.start(), 0, "assign", m.end()) for m in a.finditer(t) if len(m[2]) >= 8] + [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16] + [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(want)).encode()).hexdigest()
    assert secret_report(spark, empty).count() == 0


def test_scores(spark, docs, empty):
    from tessera.llm.lm_scoring import score_documents

    # a null id is in no fold, so that it is learnt from
    texts = [(r[0], [*(r[1] or "").encode().lower().split(), None]) for r in corpus()]
    c = collections.Counter()
    for i, w in texts:
        if i is None or zlib.crc32(str(i).encode()) % 10:
            c.update(w)
    n, v = sum(c.values()), len(c)
    got = {r.doc_id: r for r in score_documents(spark, docs, vocabulary=32, classes=4, head=50).collect()}
    for i, w in texts:
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
        assert abs(got[i].base_score - base) < 1e-6 * max(1, -base) and got[i].score < 0
    assert score_documents(spark, empty).count() == 0


def test_language(spark, empty):
    from tessera.llm.language_id import identify

    words = {"en": ["the", "thing", "ering"], "de": ["der", "schung", "keit"]}
    data = [(k, " ".join(random.choices(words[x], k=30)), x) for k in range(200) for x in [["en", "de"][k % 2]]] + [(900, None, "en"), (901, "123 !", "de"), (902, "the der", None)]
    got = {r.doc_id: r for r in identify(spark, spark.createDataFrame(data, "doc_id long, text string, lang string")).collect()}
    assert all(got[k].lang_pred == x for k, _, x in data[:200]) and got[900].lang_pred == got[901].lang_pred == "und" and 0 <= got[902].score <= 1
    assert identify(spark, spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def test_rare_language_is_learnt(spark):
    from tessera.llm.language_id import identify

    words = {"en": ["the", "thing", "ering"], "xx": ["qoz", "qazq", "zuqo"]}
    data = [(k, " ".join(random.choices(words["xx" if k % 200 == 7 else "en"], k=30)), "xx" if k % 200 == 7 else "en") for k in range(2000)]
    data += [(5000 + k, t, x) for k, (_, t, x) in enumerate(data[:50])] + data[:20]  # equal texts, repeated rows
    df = spark.createDataFrame(data, "doc_id long, text string, lang string").selectExpr("*", "'x' AS score", "1 AS held_out")
    got = identify(spark, df, sample=120, least=5).collect()
    want = {k: x for k, _, x in data}
    assert len(got) == len(data) and all(r.lang_pred == want[r.doc_id] for r in got)
    assert [r.held_out for r in got] == [zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in got]


def test_toxic(spark, empty):
    from tessera.llm.toxicity import not_toxic, severity

    data = [(k, " ".join(random.choices(W, k=20)) + (" scum" if k % 5 == 0 else ""), k % 5 == 0) for k in range(300)] + [(900, None, False), (901, "", False)]
    docs = spark.createDataFrame([r[:2] for r in data], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], int(r[2]), 1) for r in data[:200]] + [(77777, 1, 0), (3, None, 0)], "doc_id long, toxic int, severity int")
    got = {r.doc_id: r for r in severity(spark, docs, labels).collect()}
    assert all(got[k].toxic == t for k, _, t in data)
    assert sorted(r.doc_id for r in not_toxic(spark, docs, labels).collect()) == [k for k, _, t in data if not t]
    assert severity(spark, docs, labels.limit(0)).filter("toxic").count() == 0


def test_leaks(spark, docs, empty):
    from tessera.llm.decontamination import clean, lcs, leaks

    assert lcs([1, 2, 3, 4], [2, 9, 4, 1]) == 2
    w = PASSAGE.split()[20:60]
    items = spark.createDataFrame([(1, " ".join(w)), (2, " ".join(f"z{k}" for k in range(30))), (3, None), (None, "q r s t u")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leaks(spark, docs, items).collect()}
    want = {(i, 1) for i, t in rows().items() if " ".join(w) in t}
    assert got == want and want
    left = {r.doc_id for r in clean(spark, docs, items).collect()}
    assert left == {r[0] for r in corpus()} - {i for i, _ in want}
    assert leaks(spark, empty, items).count() == 0


def test_leaks_of_items_with_one_id(spark):
    from tessera.llm.decontamination import clean, leaks

    rng = random.Random(8)
    p, q, other = (" ".join("".join(rng.choices("abcdefgh", k=7)) for _ in range(40)) for _ in range(3))
    items = spark.createDataFrame([(1, p), (1, q), (1, q), (2, p)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"{other} {p}"), (2, q), (3, other), (4, None)], "doc_id long, text string")
    for block in (5000, 1):
        assert sorted((r.doc_id, r.item_id) for r in leaks(spark, docs, items, block=block).collect()) == [(1, 1), (1, 2), (2, 1)]
        assert sorted(r.doc_id for r in clean(spark, docs, items, block=block).collect()) == [3, 4]


def test_reworded_copies_against_all_pairs(spark):
    """Of copies with 10 to 38 % of their words replaced, at least nine of ten that the check of common subsequences passes are found by the cosine search."""
    from tessera.llm.decontamination import leaks

    rng = random.Random(9)
    vocabulary = ["".join(rng.choices("abcdefghijklm", k=rng.randrange(3, 9))) for _ in range(800)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = {i: text(rng.randrange(15, 60)) for i in range(30)}
    docs = {}
    for k in range(120):
        copy = [rng.choice(vocabulary) if rng.random() < rng.uniform(0.1, 0.38) else w for w in items[k % 30]] if k % 2 else []
        docs[k] = text(rng.randrange(0, 80)) + copy + text(rng.randrange(0, 80))

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    # windows of the widths that a passing copy can have, all of them
    want = {(d, i) for d, t in docs.items() for i, m in items.items() if any(common(m, t[a : a + 2 * len(m)]) >= 0.6 * len(m) for a in range(0, max(1, len(t) - len(m)), max(1, len(m) // 4)))}
    got = {(r.doc_id, r.item_id) for r in leaks(spark, spark.createDataFrame([(d, " ".join(t)) for d, t in docs.items()], "doc_id long, text string"), spark.createDataFrame([(i, " ".join(m)) for i, m in items.items()], "item_id long, text string")).collect()}
    assert len(want) >= 40 and len(got & want) >= 0.9 * len(want)
    assert all(common(items[i], docs[d]) >= 0.6 * len(items[i]) for d, i in got)


def test_leaks_of_long_items(spark):
    """Items of more than four times the widest basic window, copied verbatim."""
    from tessera.llm.decontamination import clean, leaks

    rng = random.Random(6)
    long = {m: " ".join(rng.choices(W, k=m)) for m in (20, 300, 2000)}
    filler = [" ".join(rng.choices(W, k=500)) for _ in range(20)]
    texts = [*filler, *(f"{filler[0]} {t} {filler[1]}" for t in long.values()), *long.values()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame(list(long.items()), "item_id long, text string")
    want = {(20, 20), (21, 300), (22, 2000), (23, 20), (24, 300), (25, 2000)}
    got = {(r.doc_id, r.item_id): r for r in leaks(spark, docs, items).collect()}
    assert set(got) == want and all(r.lcs_share == 1 for r in got.values())
    assert {r.doc_id for r in clean(spark, docs, items).collect()} == set(range(20))


def test_leaks_without_the_rarest_words(spark):
    """Rewordings of items of common words that replace just the words the corpus doesn't know; any window is as good as the check."""
    from tessera.llm.decontamination import lcs, leaks

    rng = random.Random(7)
    common = W[:60]
    filler = [" ".join(rng.choices(common, k=60)) for _ in range(60)]
    own = {i: rng.choices(common, k=36) for i in range(5)}
    for i, w in own.items():
        w[3:19:4] = [f"u{i}_{k}" for k in range(4)]
    copies = [" ".join(f"v{k}" if x.startswith("u") else x for k, x in enumerate(w)) for w in own.values()]
    texts = [*filler, *(f"{a} {c} {b}" for a, c, b in zip(filler, copies, filler[1:]))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(i, " ".join(w)) for i, w in own.items()], "item_id long, text string")
    assert all(lcs(w, c.split()) == 32 for w, c in zip(own.values(), copies))
    got = {(r.doc_id, r.item_id) for r in leaks(spark, docs, items).collect()}
    assert got >= {(60 + i, i) for i in own}


def test_model_vocabulary_grows_with_the_input(spark, monkeypatch):
    from tessera.llm import lm_scoring

    seen = []

    class Seen(lm_scoring.Vocabulary):
        def __init__(self, *args):
            super().__init__(*args)
            seen.append((self.count(self.own).sum() / self.total, self.size))

    monkeypatch.setattr(lm_scoring, "Vocabulary", Seen)
    for n in (10, 50):
        docs = spark.createDataFrame([(None, " ".join(f"q{100 * k + j}" for j in range(100))) for k in range(n)], "doc_id long, text string")
        assert all(r.score < 0 for r in lm_scoring.score_documents(spark, docs).collect())
    assert all(covered >= 0.6 for covered, _ in seen) and seen[1][1] > 2900 > seen[0][1]


def test_leaks_without_an_answer(spark):
    """The first three quarters of an item are a leak unless its answer is known and missing."""
    from tessera.llm.decontamination import leaks

    w = PASSAGE.split()[:40]
    docs = spark.createDataFrame([(1, " ".join(w[:30])), (2, " ".join(w[:16]))], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(w), None), (2, " ".join(w), " ".join(w[30:])), (3, " ".join(w), " ".join(w[20:30]))], "item_id long, text string, answer string")
    assert {(r.doc_id, r.item_id, r.lcs_share, r.answer_share) for r in leaks(spark, docs, items).collect()} == {(1, 1, 0.75, None), (1, 3, 0.75, 1.0)}
    assert {(r.doc_id, r.item_id) for r in leaks(spark, docs, items.drop("answer")).collect()} == {(1, 1), (1, 2), (1, 3)}

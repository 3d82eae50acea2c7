"""Operator 2, benchmark decontamination by latent semantic retrieval.

TF-IDF vectors (hashed words, document frequencies over all documents) of the benchmark's passages are
decomposed by a distributed randomised SVD. Windows of the documents, of widths up to that of the longest passage, are folded into
the latent space; passages whose cosine is high enough are candidates. A candidate is a leak if the longest
common subsequence of words covers enough of the passage and, where one is given, of its answer: so are verbatim and
reworded copies found.

Scale: two narrow scans of the documents, without a shuffle of them. The benchmark goes with the
tasks in blocks of at most ``block`` items, each of which scans again; matrices have a fixed number of rows. A window is
only folded in if the words around it hold as many of one item's rarest as any copy that passes the check must.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, need, tune
from .words import Words, ragged, words

FEATURES = 1 << 14
WIDTHS = (16, 32, 64)  # and on, for longer items


def feature(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(50)).astype(np.int64)


def widths_for(longest: int) -> tuple[int, ...]:
    """Widths of windows, doubled until one holds the longest item: each item meets windows from a quarter of its length up."""
    out = list(WIDTHS)
    while out[-1] < longest:
        out.append(2 * out[-1])
    return tuple(out)


def frequencies(docs: DataFrame, vocabulary: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of documents; of those with each feature; of those with each word of the vocabulary (ascending hashes)."""
    size = FEATURES + len(vocabulary)

    def count(batches):
        total, mark, rows = np.zeros(size, np.int64), np.zeros(FEATURES, np.int64), 0
        for b in batches:
            rows += len(b.column(0))
            for w in words(b.column(0), lower=True):
                f = feature(w.hash)
                for d in range(w.n):
                    mark[f[w.cut[d] : w.cut[d + 1]]] = 1
                    total[:FEATURES] += mark
                    mark[:] = 0
                k = np.minimum(np.searchsorted(vocabulary, w.hash), len(vocabulary) - 1)
                hit = np.flatnonzero(vocabulary[k] == w.hash)
                own = np.unique(w.doc[hit] * len(vocabulary) + k[hit]) % len(vocabulary)
                total[FEATURES:] += np.bincount(own, minlength=len(vocabulary))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], rows))], names=["f", "n"])

    out, rows = np.zeros(size, np.int64), 0
    for r in docs.select("text").mapInArrow(count, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).collect():  # one row a feature or word at most
        if r["f"] < 0:
            rows = r["n"]
        else:
            out[r["f"]] = r["n"]
    return rows, out[:FEATURES], out[FEATURES:]


def latent_space(passages: DataFrame, idf: np.ndarray, rank: int, rounds: int = 3, seed: int = 11) -> np.ndarray:
    """The leading right singular vectors (features, rank) of the passages' TF-IDF rows by randomised subspace iteration: each round sums A'(A Q) over the partitions."""
    q = np.random.default_rng(seed).normal(size=(FEATURES, rank)).astype(np.float32)
    for _ in range(rounds):
        basis = q

        def step(batches, basis=basis):
            total = np.zeros((FEATURES, rank), np.float32)
            for b in batches:
                for w in words(b.column(0), lower=True):
                    f = feature(w.hash)
                    for d in range(w.n):
                        k, n = np.unique(f[w.cut[d] : w.cut[d + 1]], return_counts=True)
                        v = (n * idf[k]).astype(np.float32)
                        v /= max(float(np.sqrt((v * v).sum())), 1e-9)
                        total[k] += v[:, None] * (v @ basis[k])
            at = np.flatnonzero(np.abs(total).sum(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array([total[k].tobytes() for k in at], pa.binary())], names=["f", "row"])

        def add(batches):
            total = np.zeros((FEATURES, rank), np.float32)
            for b in batches:
                for f, row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    total[f] += np.frombuffer(row, np.float32)
            at = np.flatnonzero(np.abs(total).sum(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array([total[k].tobytes() for k in at], pa.binary())], names=["f", "row"])

        new = np.zeros((FEATURES, rank), np.float64)
        for r in passages.select("text").mapInArrow(step, "f long, row binary").repartition(4, "f").mapInArrow(add, "f long, row binary").collect():  # FEATURES rows at most
            new[r["f"]] = np.frombuffer(r["row"], np.float32)
        q = np.linalg.qr(new + 1e-12 * np.random.default_rng(seed).normal(size=new.shape))[0].astype(np.float32)
    return q


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by bits of one integer (Hyyro, 2004)."""
    at: dict[int, int] = {}
    for k, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << k
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        m = at.get(y)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - bin(v).count("1")


class Markers:
    """The rarest words of each item: ``least[i]`` of those of item i stand in every text whose LCS with it is large enough."""

    def __init__(self, words_: np.ndarray, cut: np.ndarray, items: np.ndarray, least: np.ndarray):
        self.words, self.cut, self.items, self.least = words_, cut, items, least

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions and items of all markers among word hashes, ascending by item and position."""
        k = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        at = np.flatnonzero(self.words[k] == h)
        k = k[at]
        many = self.cut[k + 1] - self.cut[k]
        at, item = np.repeat(at, many), self.items[ragged(self.cut[k], many)]
        order = np.argsort(item, kind="stable")
        return at[order], item[order]

    def reach(self, at: np.ndarray, item: np.ndarray, w: Words, width: int, sizes: np.ndarray) -> np.ndarray:
        """Sums over words, to be compared at the ends of a window: more at its end if, for an item that windows of this width are compared with, the window and half the item's length on either side may hold enough markers."""
        fits = (sizes <= 4 * width) & (sizes * 4 >= width)
        last = np.arange(len(at)) + self.least[item] - 1
        first = np.flatnonzero(fits[item] & (last < len(at)))
        last = last[first]
        a, b, i = at[first], at[last], item[first]
        half = sizes[i] // 2
        doc = np.searchsorted(w.cut, a, side="right")
        ok = (item[last] == i) & (b - a < width + 2 * half) & (b < w.cut[doc])
        a, b, half, doc = a[ok], b[ok], half[ok], doc[ok]
        # such a window begins at a + half or before and ends behind b - half
        low, high = np.minimum(a + half, b - half), np.maximum(a + half, b - half)
        low, high = np.maximum(low, w.cut[doc - 1]), np.minimum(high, w.cut[doc] - 1)
        edge = np.bincount(low, minlength=len(w.hash) + 1) - np.bincount(high + 1, minlength=len(w.hash) + 1)
        return np.concatenate(([0], np.cumsum(np.cumsum(edge[:-1]) > 0)))


def markers(items: list[np.ndarray], vocabulary: np.ndarray, known: np.ndarray, share: float) -> Markers:
    """A text that passes lacks at most (1 - share) of an item's words, so that of so many and ``least`` more it holds ``least``; the rarest are chosen."""
    pairs, least = [], []
    for i, h in enumerate(items):
        k = np.searchsorted(vocabulary, h)
        lost = len(h) - max(1, math.ceil(share * len(h) - 1e-9))
        least.append(min(len(h) - lost, max(4, len(h) // 8)))
        own = np.unique(k[np.argsort(known[k], kind="stable")[: lost + least[-1]]])
        pairs.append(np.stack([own, np.full(len(own), i)]))
    word, item = np.concatenate(pairs, axis=1)
    order = np.argsort(word, kind="stable")
    unique, many = np.unique(word, return_counts=True)
    return Markers(vocabulary[unique], np.concatenate(([0], np.cumsum(many))), item[order], np.array(least))


def _membership(items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.uint64]:
    """A table of marks for the (word, item) pairs of the items, a number of each item, and the shift that gives the place of a pair: unmarked pairs are certainly none."""
    salt = mix(np.arange(1, len(items) + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    pairs = np.concatenate([h ^ s for h, s in zip(items, salt, strict=True)])
    bits = max(12, (16 * len(pairs)).bit_length())
    table, shift = np.zeros(1 << bits, np.uint8), np.uint64(64 - bits)
    with np.errstate(over="ignore"):
        table[(pairs * np.uint64(0x9E3779B97F4A7C15)) >> shift] = 1
    return table, salt, shift


def finder(spark: SparkSession, docs: DataFrame, items: list[tuple[int, np.ndarray, np.ndarray]], passages: DataFrame, rank: int, cosine: float, share: float, answer_share: float) -> Callable:
    """A function from an Arrow text column to the leaks (row, item, first word, cosine, share, answer share). items: (item_id, word hashes, answer hashes)."""
    vocabulary = np.unique(np.concatenate([h for _, h, _ in items]))
    n_docs, df, known = frequencies(docs, vocabulary)
    idf = np.log((1 + n_docs) / (1 + df)) + 1
    rank = min(rank, len(items))
    space = latent_space(passages, idf, rank)
    loaded = (space * idf[:, None]).astype(np.float32)
    fold = np.stack([loaded[feature(h)].sum(axis=0) for _, h, _ in items])
    fold /= np.maximum(np.linalg.norm(fold, axis=1, keepdims=True), 1e-9)
    sizes = np.array([len(h) for _, h, _ in items])
    widths = widths_for(int(sizes.max()))
    marks = markers([h for _, h, _ in items], vocabulary, known, share)
    lists = [(h.tolist(), a.tolist()) for _, h, a in items]
    sets = [frozenset(h) for h, _ in lists]
    needed = np.array([max(1, math.ceil(share * len(h) - 1e-9)) for h, _ in lists])
    held_by, salt, shift = _membership([h for _, h, _ in items])
    # words that may be missing are at most (1 - share) of all, the least frequent of the item at that
    distinct = [max(0.0, (len(t) - (1 - share) * len(h)) / share) for t, (h, _) in zip(sets, lists, strict=True)]

    def find(col: pa.Array):
        for w in words(col, lower=True):
            if not len(w.hash):
                continue
            held, of = marks.hits(w.hash)
            tried: dict[tuple[int, int], tuple] = {}
            for width in widths:
                step = width // 4
                many = np.maximum(1, -(-(w.count - width) // step) + 1) * (w.count > 0)
                doc = np.repeat(np.arange(w.n), many)
                start = w.cut[doc] + ragged(np.zeros(w.n, np.int64), many) * step
                stop = np.minimum(start + width, w.cut[doc + 1])
                seen = marks.reach(held, of, w, width, sizes)
                ok = seen[stop] > seen[start]
                if not ok.any():
                    continue
                doc, start, stop = doc[ok], start[ok], stop[ok]
                size = stop - start
                own = np.add.reduceat(loaded[feature(w.hash)[ragged(start, size)]], np.cumsum(size) - size, axis=0)
                own /= np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-9)
                close = own @ fold.T
                close[:, (sizes > 4 * width) | (sizes * 4 < width)] = 0
                row, item = np.nonzero(close >= cosine)
                begin = np.maximum(w.cut[doc[row]], start[row] - sizes[item] // 2)
                end = np.minimum(w.cut[doc[row] + 1], stop[row] + sizes[item] // 2)
                # the words around that are words of the item are no fewer than the common subsequence
                many = np.zeros(len(row), np.int64)
                parts = np.flatnonzero(np.diff(np.cumsum(end - begin) >> 20, prepend=-1))
                for a, b in zip(parts, np.append(parts[1:], len(row)), strict=True):
                    size = end[a:b] - begin[a:b]
                    slot = ((w.hash[ragged(begin[a:b], size)] ^ np.repeat(salt[item[a:b]], size)) * np.uint64(0x9E3779B97F4A7C15)) >> shift
                    many[a:b] = np.add.reduceat(held_by[slot], np.cumsum(size) - size, dtype=np.int64)
                near = np.flatnonzero(many >= needed[item])
                for r, i, lo, hi in zip(*(x[near].tolist() for x in (row, item, begin, end)), strict=True):
                    m, d = int(sizes[i]), int(doc[r])
                    here = w.hash[lo:hi].tolist()
                    if len(sets[i].intersection(here)) < share * distinct[i] - 1e-9:
                        continue  # too few of its words in any order
                    got = lcs(lists[i][0], here) / m
                    if got < share or ((d, i) in tried and got <= tried[d, i][2]):
                        continue
                    answer = lcs(lists[i][1], here) / len(lists[i][1]) if lists[i][1] else None
                    if answer is None or answer >= answer_share:
                        tried[d, i] = (lo - int(w.cut[d]), float(close[r, i]), got, answer)
            for (d, i), (at, c, share_, x) in sorted(tried.items()):
                yield w.first + d, items[i][0], at, c, share_, x

    return find


def _blocks(benchmark: DataFrame, block: int):
    """The items by blocks of at most ``block``, in order of item_id and a hash of their text and answer: word hashes of both. Items that share an id are items of their own."""
    answered = "answer" in benchmark.columns
    own = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text", (F.col("answer") if answered else F.lit(None)).cast("string").alias("answer"))
    own = own.filter("item_id is not null and text is not null").distinct().withColumn("key", F.xxhash64("text", "answer"))
    last = None
    while True:
        rest = own if last is None else own.filter((F.col("item_id") > last[0]) | ((F.col("item_id") == last[0]) & (F.col("key") > last[1])))
        part = rest.orderBy("item_id", "key").limit(block)
        rows = part.collect()
        if not rows:
            return
        items = []
        for r in rows:
            h = np.concatenate([w.hash for w in words(pa.array([r["text"]]), lower=True)] or [np.zeros(0, np.uint64)])
            a = np.concatenate([w.hash for w in words(pa.array([r["answer"]]), lower=True)]) if r["answer"] else h[:0]
            if len(h) >= 4:
                items.append((r["item_id"], h, a))
        if items:
            yield items, part
        last = rows[-1]["item_id"], rows[-1]["key"]


def leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, rank: int = 96, cosine: float = 0.35, share: float = 0.6, answer_share: float = 0.5, block: int = 5000) -> DataFrame:
    """doc_id, item_id, first_word, cosine, lcs_share, answer_share: a row for each document and item that it leaks; clean documents have none.

    ``answer`` of the benchmark is the item's answer; without it answer_share is null and the passage alone decides. Items with a null
    item_id, null text or fewer than four words are left out; different items that share an item_id are each looked for, equal ones once. Null and empty documents are clean. Repeated rows are found each.
    """
    tune(spark, 1024)
    docs = need(docs, "doc_id", "text")
    schema = "doc_id long, item_id long, first_word long, cosine double, lcs_share double, answer_share double"
    out = spark.createDataFrame([], schema)
    for items, part in _blocks(benchmark, block):
        find = finder(spark, docs, items, part, rank, cosine, share, answer_share)

        def search(batches, find=find):
            for b in batches:
                ids = b.column(0).to_pylist()
                rows = [(ids[r[0]], *r[1:]) for r in find(b.column(1))]
                if rows:
                    cols = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.float64()) for c in cols[3:])], names=["doc_id", "item_id", "first_word", "cosine", "lcs_share", "answer_share"])

        found = docs.mapInArrow(search, schema)
        out = found if len(out.columns) and out.isLocal() else out.unionByName(found)
    return out


def clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, rank: int = 96, cosine: float = 0.35, share: float = 0.6, answer_share: float = 0.5, block: int = 5000) -> DataFrame:
    """The documents without a leak, with all their columns, in one map over each block of the benchmark."""
    tune(spark, 1024)
    whole = docs  # frequencies are those of all documents, whatever earlier blocks took away
    for items, part in _blocks(benchmark, block):
        find = finder(spark, whole, items, part, rank, cosine, share, answer_share)
        at = docs.columns.index("text")

        def keep(batches, find=find, at=at):
            for b in batches:
                stay = np.ones(len(b.column(0)), bool)
                stay[[r[0] for r in find(b.column(at))]] = False
                yield b.filter(pa.array(stay))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs

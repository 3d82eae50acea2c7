"""Operator 6, substring dedup: Rabin-Karp hashes of every fixed-length word window, counted in Spark.

Windows that repeat are removed but for the first (smallest doc_id, then earliest start); the windows
that go merge into maximal intervals of words. Windows that cannot repeat, as a short gram in each of
them occurs once in the corpus, are told first (repeats.py), so that only the rest is shuffled.

Scale: only documents that may hold a repeat are shuffled. A batch sends each window hash (128 bits) once, with its first
place and, packed, the places that are later than that. Windows with an anchor that more than ``hot`` runs have (a passage in a third
of all documents) get their first places by map-side minima joined back, which Spark can split; the others, with no more places than
that, by a window function.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, mix, rolling, runs_of, sliding_min, tune
from .exact_dedup import normalised
from .repeats import blobs, candidates, documents, held_twice, keyed, merged, unpacked
from .words import Words, ragged, words

LATER = np.dtype([("doc", "<i8"), ("key", "<i8"), ("start", "<i4")])


def word_runs(window: int):
    gram = max(1, window // 2)  # half a window: shorter ones are common phrases, longer ones give more anchors
    span = window - gram + 1

    def runs(col):
        for w in words(col):
            n = len(w.hash) - window + 1
            if n <= 0:
                continue
            grams = mix(rolling(w.hash, gram))
            anchors = sliding_min(grams, span)[:n]
            doc = w.doc[:n]
            ok = w.cut[doc + 1] - np.arange(n) >= window
            start, length = runs_of(anchors)
            edge = np.zeros(n, bool)
            edge[start] = True
            edge[w.cut[:-1][w.cut[:-1] < n]] = True
            edge[1:] |= ok[1:] != ok[:-1]
            start = np.flatnonzero(edge)
            length = np.diff(np.append(start, n))
            keep = ok[start]
            start, length = start[keep], length[keep]
            yield w.first + doc[start], anchors[start], start - w.cut[doc[start]], length, held_twice(grams, anchors[start], start, length, span)

    return runs


def window_rows(window: int, hot: int):
    """For each hash and batch: its first place and the packed later ones."""

    def rows(batches):
        for b in batches:
            ids, own, runs = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(3).to_pylist()
            hashes, more, docs, keys, at, frequent = [], [], [], [], [], []
            for w in words(b.column(2)):
                if len(w.hash) < window:
                    continue
                h, g = mix(rolling(w.hash, window)), mix(rolling(mix(w.hash ^ np.uint64(0x5851F42D4C957F2D)), window))
                for d in range(w.n):
                    n = int(w.cut[d + 1] - w.cut[d]) - window + 1
                    if n <= 0:
                        continue
                    place = unpacked(runs[w.first + d])
                    k, at_run = np.unique(ragged(place["start"].astype(np.int64), place["length"].astype(np.int64)), return_index=True)
                    often = (np.repeat(place["all"], place["length"]) > hot)[at_run][k < n]
                    k = k[k < n]
                    frequent.append(often)
                    hashes.append(h[w.cut[d] + k])
                    more.append(g[w.cut[d] + k])
                    at.append(k)
                    docs.append(np.full(len(k), ids[w.first + d]))
                    keys.append(np.full(len(k), own[w.first + d]))
            if not hashes:
                continue
            hashes, more, docs, keys, at, frequent = map(np.concatenate, (hashes, more, docs, keys, at, frequent))
            if not len(hashes):
                continue
            order = np.lexsort((at, keys, docs, more, hashes))
            hashes, more, docs, keys, at, frequent = (x[order] for x in (hashes, more, docs, keys, at, frequent))
            first = np.flatnonzero(np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (more[1:] != more[:-1]))))
            count = np.diff(np.append(first, len(hashes)))
            later = np.ones(len(hashes), bool)
            later[first] = False
            # a repeated row of the input is the same place, not a later one
            same = np.zeros(len(hashes), bool)
            same[1:] = (hashes[1:] == hashes[:-1]) & (more[1:] == more[:-1]) & (docs[1:] == docs[:-1]) & (keys[1:] == keys[:-1]) & (at[1:] == at[:-1])
            head = np.repeat(first, count)
            later &= ~same & ~((docs == docs[head]) & (keys == keys[head]) & (at == at[head]))
            place = np.zeros(int(later.sum()), LATER)
            place["doc"], place["key"], place["start"] = docs[later], keys[later], at[later]
            begins = np.concatenate(([0], np.cumsum(later)))[first]
            yield pa.RecordBatch.from_arrays([pa.array(hashes[first].view(np.int64)), pa.array(more[first].view(np.int64)), pa.array(docs[first]), pa.array(keys[first]), pa.array(at[first].astype(np.int32)), blobs(place, begins), pa.array(frequent[first])], names=["h", "g", "doc_id", "key", "at", "later", "hot"])

    return rows


def gone(batches):
    """Places to remove, packed by document."""
    for b in batches:
        own = np.flatnonzero(b.column(4).to_numpy(zero_copy_only=False))
        first = np.zeros(len(own), LATER)
        first["doc"], first["key"], first["start"] = (b.column(i).to_numpy()[own] for i in range(3))
        place = np.concatenate([first, np.frombuffer(b"".join(b.column(3).to_pylist()), LATER)])
        if not len(place):
            continue
        place = place[np.lexsort((place["key"], place["doc"]))]
        at = documents(place["doc"], place["key"])
        yield pa.RecordBatch.from_arrays([pa.array(place["doc"][at]), pa.array(place["key"][at]), blobs(np.ascontiguousarray(place["start"]), at)], names=["doc_id", "key", "starts"])


def kept_words(w: Words, d: int, begin: np.ndarray, end: np.ndarray) -> bytes:
    cover = np.zeros(int(w.cut[d + 1] - w.cut[d]) + 1, np.int64)
    np.add.at(cover, begin, 1)
    np.add.at(cover, end, -1)
    k = np.flatnonzero(np.cumsum(cover)[:-1] == 0) + w.cut[d]
    return b" ".join([w.text(i) for i in k])


def substring_dedup(spark: SparkSession, docs: DataFrame, window: int = 20, hot: int = 100_000) -> DataFrame:
    """The documents from which something goes: doc_id, key (as keyed() has them), text, kept, begins array<int>, ends array<int> (in words, end exclusive).

    Null and empty texts, and those with fewer words than a window, lose nothing. A null doc_id orders
    before all others. Texts that share a doc_id, or have none, are documents of their own, ordered among themselves by a hash of the text.
    Rows equal in doc_id and text are one document: each loses what it does, and none is earlier than the other.
    """
    tune(spark, 2048)
    scratch = Scratch(spark, "substring")
    docs = keyed(docs).drop("given")
    some, most = candidates(scratch, docs, word_runs(window), kept=False)
    rows = some.mapInArrow(window_rows(window, hot), "h long, g long, doc_id long, key long, at int, later binary, hot boolean")
    key, place = ["h", "g"], F.struct("doc_id", "key", "at")
    if most > hot:
        rows = scratch.write(rows)
        first = rows.filter("hot").groupBy(*key).agg(F.min(place).alias("first"))
        marked = rows.filter("not hot").withColumn("first", F.min(place).over(Window.partitionBy(*key))).select(*rows.columns, "first").unionByName(rows.filter("hot").join(first, key).select(*rows.columns, "first"))
    else:
        marked = rows.withColumn("first", F.min(place).over(Window.partitionBy(*key)))
    marked = marked.withColumn("own", place != F.col("first")).filter("own or length(later) > 0").select("doc_id", "key", "at", "later", "own")
    starts = scratch.write(marked.mapInArrow(gone, "doc_id long, key long, starts binary"))
    if most > hot:
        scratch.drop(rows)
    del rows, marked
    scratch.free_shuffles()
    starts = starts.groupBy("doc_id", "key").agg(F.collect_list("starts").alias("starts"))

    def cut(batches):
        for b in batches:
            lists = b.column(3).to_pylist()
            kept, begins, ends = [], [], []
            for w in words(b.column(2)):
                for d in range(w.n):
                    s = np.unique(np.frombuffer(b"".join(lists[w.first + d]), np.int32)).astype(np.int64)
                    s = s[s <= w.cut[d + 1] - w.cut[d] - window]
                    begin, end = merged(s, window)
                    kept.append(kept_words(w, d, begin, end))
                    begins.append(begin.astype(np.int32))
                    ends.append(end.astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(begins, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32()))], names=["doc_id", "key", "text", "kept", "begins", "ends"])

    return some.select("doc_id", "key", "text").join(starts, ["doc_id", "key"]).mapInArrow(cut, "doc_id long, key long, text string, kept string, begins array<int>, ends array<int>")


def substring_report(spark: SparkSession, docs: DataFrame, window: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: one row for each input row, of which most are digested where they are read."""
    plain = F.expr("trim(BOTH ' ' FROM t)")
    base = keyed(docs).select("doc_id", "key", "given", normalised(F.col("text")).alias("t")).select("doc_id", "key", "given", plain.alias("t"))
    base = base.select("doc_id", "key", "given", F.when(F.col("t") == "", 0).otherwise(F.length("t") - F.length(F.expr("replace(t, ' ', '')")) + 1).cast("long").alias("n_words"), F.sha2("t", 256).alias("sha"))
    changed = _changed(substring_dedup(spark, docs, window))
    return base.join(changed, ["doc_id", "key"], "left").select(F.col("given").alias("doc_id"), "n_words", F.coalesce("gone", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("left_sha", "sha").alias("kept_sha256"))


def _changed(found: DataFrame) -> DataFrame:
    total = F.expr("aggregate(zip_with(begins, ends, (a, b) -> cast(b - a as bigint)), 0L, (x, y) -> x + y)")
    return found.select("doc_id", "key", total.alias("gone"), F.sha2("kept", 256).alias("left_sha")).dropDuplicates(["doc_id", "key"])

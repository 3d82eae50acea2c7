"""Operator 10, suffix-array dedup: threshold-bounded interval expansion on a Burrows-Wheeler transform.

Every byte covered by a string of ``limit`` bytes that is anywhere else too goes, all copies alike.

Windows that cannot repeat are told first (repeats.py). Each window left belongs to one anchor, and
equal windows to the same one, so that the stretches of text with one anchor (segments) meet in one
task. There many anchors' segments are joined to one text, whose transform is expanded (bwt.py)
to tell which places have a common prefix of ``limit`` bytes with another.

Scale: equal segments are one row a task with a weight before they are shuffled. An anchor that very
many segments hold (a passage in a third of all documents) is divided: its segments are cut to blocks
of successive windows at fixed distances from the anchor, the shorter the more there are, keyed also by
what all windows of a block share. Equal windows still meet, and what only surrounds the passage does not.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bwt import repeated
from .common import Scratch, flat, mix, rolling, runs_of, sliding_min, tune
from .repeats import LOCAL, blobs, candidates, documents, held_twice, keyed, merged, unpacked

GRAM = 32


def byte_grams(data: np.ndarray) -> np.ndarray:
    return mix(rolling(data.astype(np.uint64) + np.uint64(1), GRAM))


def byte_runs(limit: int, size: int = 1 << 15):
    span = limit - GRAM + 1

    def runs(col):
        data, offsets = flat(col)
        a = 0
        while a < len(col):  # some whole documents at a time, as much as caches hold
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, side="right")) - 1)
            part, off = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            n = len(part) - limit + 1
            if n > 0:
                grams = byte_grams(part)
                anchors = sliding_min(grams, span)
                edge = np.zeros(n, bool)
                edge[0] = True
                edge[1:] = anchors[1:] != anchors[:-1]
                last = np.maximum(off[1:] - limit + 1, off[:-1])  # behind the last window of each document
                edge[off[:-1][off[:-1] < n]] = True
                edge[last[last < n]] = True
                start = np.flatnonzero(edge)
                length = np.diff(np.append(start, n))
                doc = np.searchsorted(off, start, side="right") - 1
                keep = start + limit <= off[doc + 1]
                start, length, doc = start[keep], length[keep], doc[keep]
                yield a + doc, anchors[start], start - off[doc], length, held_twice(grams, anchors[start], start, length, span)
            a = b

    return runs


def block_of(holders: int) -> int:
    """Windows in a block for an anchor with so many segments; 0: they are not cut."""
    return 0 if holders <= 2_000 else 64 if holders <= 1_000_000 else 8 if holders <= 100_000_000 else 1


def segments_of(data: np.ndarray, place: np.ndarray, limit: int):
    """(key, start, bytes) of the segments of one document; keys of blocks are even."""
    raw = data.tobytes()
    for anchor, holders, start, length in place.tolist():
        end = min(start + length + limit - 1, len(raw))
        if end - start < limit:
            continue
        block = block_of(holders)
        if not block:
            yield anchor | 1, start, raw[start:end]
            continue
        grams = byte_grams(data[start:end]).view(np.int64)
        hits = np.flatnonzero(grams == anchor)
        t, n = 0, end - start - limit + 1
        while t < n:  # up to the window whose distance to its first anchor begins another block
            p = int(hits[np.searchsorted(hits, t)])
            q = (p - t) // block
            last = p - q * block  # of the windows of this block; any of them covers the core
            stop = min(n, last + 1)
            core = raw[start + last : start + last - block + 1 + limit]
            yield hash_of(core, anchor, q) & ~1, start + t, raw[start + t : start + stop + limit - 1]
            t = stop


def hash_of(core: bytes, anchor: int, block: int) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(core, seed=(anchor ^ block * 0x9E3779B1) & (2**64 - 1)) - 2**63


def segment_rows(limit: int):
    def rows(batches):
        for b in batches:
            ids, runs = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True), b.column(3).to_pylist()
            data, offsets = flat(b.column(2))
            found: dict[tuple[int, bytes], list[tuple[tuple[int, int], int]]] = {}
            for d, doc in enumerate(ids):
                own = data[offsets[d] : offsets[d + 1]]
                for key, start, segment in segments_of(own, unpacked(runs[d]), limit):
                    found.setdefault((key, segment), []).append((doc, start))
            if not found:
                continue
            many = np.array([len(v) for v in found.values()])
            place = np.zeros(int(many.sum()), LOCAL)
            flat_ = [x for v in found.values() for x in v]
            place["doc"], place["key"], place["start"] = [x[0][0] for x in flat_], [x[0][1] for x in flat_], [x[1] for x in flat_]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([s for _, s in found], pa.binary()), blobs(place, np.cumsum(many) - many)], names=["key", "segment", "places"])

    return rows


def expand(limit: int, size: int):
    """Rows sorted by key to (doc_id, packed starts of windows that repeat)."""

    def solve(keys: list[int], segments: list[bytes], places: list[bytes]):
        at: dict[tuple[int, bytes], list[bytes]] = {}
        groups: dict[int, int] = {}
        for k, s, p in zip(keys, segments, places, strict=True):
            if (k, s) in at:
                at[k, s].append(p)
            else:
                at[k, s] = [p]
                groups[k] = groups.get(k, 0) + 1
        texts, weights, own = [], [], []
        ids, own_keys, pairs = [], [], []  # the runs of windows that repeat

        def mark(place: np.ndarray, begin: np.ndarray, size: np.ndarray) -> None:
            ids.append(np.repeat(place["doc"], len(begin)))
            own_keys.append(np.repeat(place["key"], len(begin)))
            pairs.append(np.column_stack([(place["start"].astype(np.int64)[:, None] + begin).ravel(), np.tile(size, len(place))]).astype(np.int32))

        for (k, s), ps in at.items():
            place = np.unique(np.frombuffer(b"".join(ps), LOCAL))  # a repeated row of the input is one place
            if groups[k] == 1 and len(place) > 1:  # nothing else has the key, and the segment as a whole repeats
                mark(place, np.zeros(1, np.int64), np.array([len(s) - limit + 1]))
            elif groups[k] > 1 or k & 1:  # no two windows of one block are equal
                texts.append(s)
                weights.append(len(place))
                own.append(place)
        if texts:
            for flag, place in zip(repeated(texts, np.array(weights), limit), own, strict=True):
                edge = np.flatnonzero(np.diff(np.concatenate(([0], flag.astype(np.int8), [0]))))
                if len(edge):
                    mark(place, edge[::2], edge[1::2] - edge[::2])
        if not ids:
            return None
        docs, doc_keys, pair = np.concatenate(ids), np.concatenate(own_keys), np.concatenate(pairs)
        order = np.lexsort((doc_keys, docs))
        docs, doc_keys, pair = docs[order], doc_keys[order], pair[order]
        cut = documents(docs, doc_keys)
        return pa.RecordBatch.from_arrays([pa.array(docs[cut]), pa.array(doc_keys[cut]), blobs(np.ascontiguousarray(pair).view([("a", "<i4"), ("n", "<i4")]).ravel(), cut)], names=["doc_id", "key", "starts"])

    def rows(batches):
        keys: list[int] = []
        segments: list[bytes] = []
        places: list[bytes] = []
        total = 0
        for b in batches:
            for k, s, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if total >= size and keys[-1] != k:
                    if (out := solve(keys, segments, places)) is not None:
                        yield out
                    keys, segments, places, total = [], [], [], 0
                keys.append(k)
                segments.append(s)
                places.append(p)
                total += len(s)
        if keys and (out := solve(keys, segments, places)) is not None:
            yield out

    return rows


def suffix_dedup(spark: SparkSession, docs: DataFrame, limit: int = 400, size: int = 1 << 20) -> DataFrame:
    """The documents from which something goes: doc_id, key (as keyed() has them), text, kept binary, begins array<int>, ends array<int> (in bytes, end exclusive).

    Null and empty texts, and those shorter than ``limit`` bytes, lose nothing. Texts that share a doc_id, or have none, are documents of their own.
    Rows equal in doc_id and text are one document, not copies of each other.
    """
    tune(spark, 1024)
    scratch = Scratch(spark, "suffix")
    docs = keyed(docs).drop("given")
    some, _ = candidates(scratch, docs, byte_runs(limit), kept=True)
    rows = some.mapInArrow(segment_rows(limit), "key long, segment binary, places binary")
    rows = rows.repartition("key").sortWithinPartitions("key")
    starts = scratch.write(rows.mapInArrow(expand(limit, size), "doc_id long, key long, starts binary"))
    del rows
    scratch.free_shuffles()
    starts = starts.groupBy("doc_id", "key").agg(F.collect_list("starts").alias("starts"))

    def cut(batches):
        from .words import ragged

        for b in batches:
            data, offsets = flat(b.column(2))
            kept, begins, ends = [], [], []
            for d, packed in enumerate(b.column(3).to_pylist()):
                own = data[offsets[d] : offsets[d + 1]]
                pair = np.frombuffer(b"".join(packed), np.int32).reshape(-1, 2).astype(np.int64)
                s = np.unique(ragged(pair[:, 0], pair[:, 1]))
                begin, end = merged(s[s <= len(own) - limit], limit)
                cover = np.zeros(len(own) + 1, np.int32)
                cover[begin] += 1
                cover[end] -= 1
                kept.append(own[np.cumsum(cover)[:-1] == 0].tobytes())
                begins.append(begin.astype(np.int32))
                ends.append(end.astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(kept, pa.binary()), pa.array(begins, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32()))], names=["doc_id", "key", "text", "kept", "begins", "ends"])

    return some.select("doc_id", "key", "text").join(starts, ["doc_id", "key"]).mapInArrow(cut, "doc_id long, key long, text string, kept binary, begins array<int>, ends array<int>")


def suffix_report(spark: SparkSession, docs: DataFrame, limit: int = 400) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row for each input row, of which most are digested where they are read."""
    base = keyed(docs).select("doc_id", "key", "given", F.coalesce("text", F.lit("")).alias("t")).select("doc_id", "key", "given", F.octet_length("t").cast("long").alias("n_bytes"), F.sha2("t", 256).alias("sha"))
    total = F.expr("aggregate(zip_with(begins, ends, (a, b) -> cast(b - a as bigint)), 0L, (x, y) -> x + y)")
    changed = suffix_dedup(spark, docs, limit).select("doc_id", "key", total.alias("gone"), F.size("begins").cast("long").alias("spans"), F.sha2("kept", 256).alias("left_sha")).dropDuplicates(["doc_id", "key"])
    zero = F.lit(0).cast("long")
    return base.join(changed, ["doc_id", "key"], "left").select(F.col("given").alias("doc_id"), "n_bytes", F.coalesce("gone", zero).alias("n_removed"), F.coalesce("spans", zero).alias("n_spans"), F.coalesce("left_sha", "sha").alias("kept_sha256"))

"""What operators 6 and 10 share: finding where repeated windows can be at all, without looking at all pairs.

Each window of a fixed length holds an anchor: the smallest hash of the short grams within it. Equal
windows have equal anchors, so that windows whose anchor occurs once in the corpus do not repeat.
Successive windows mostly share an anchor, so that few rows are counted. This is lossless; what is
left is examined exactly. All tables grow in proportion to the input, and nothing but bit tables of bounded size is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bloom, Scratch, need, runs_of
from .words import ragged

#: The runs of windows with one anchor, of the texts of a batch: (rows, anchors, starts, lengths, whether the anchor is in the run's windows more than once)
Runs = Callable[[pa.Array], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]
NONE = -(2**63)


def candidates(scratch: Scratch, docs: DataFrame, runs: Runs, kept: bool) -> tuple[DataFrame, int]:
    """doc_id, key, text and a list of packed PLACE records, written: the runs of windows whose anchor is not alone, with the number of runs that have it; and the highest of these numbers.

    Within one run windows repeat only if the anchor is there twice (periodic texts). A task emits one row an anchor and batch, with all
    places packed. Anchors are counted with map-side sums and joined back, so that Spark can split a frequent one; only
    rows of repeated anchors, and texts that hold one, are shuffled as long as the bit tables hold. kept: the rows of runs are written, for runs that are few and
    costly; else they are found once more.
    """

    def emit(places: bool, among=None):
        def rows(batches):
            for b in batches:
                got = [x for x in runs(b.column(2)) if len(x[0])]
                if not got:
                    continue
                rows, anchors, start, length, twice = (np.concatenate(x) for x in zip(*got, strict=True))
                if among is not None:
                    some = among(anchors.view(np.int64))
                    rows, anchors, start, length, twice = (x[some] for x in (rows, anchors, start, length, twice))
                    if not len(rows):
                        continue
                order = np.argsort(anchors, kind="stable")
                first, count = runs_of(anchors[order])
                cols = {"anchor": pa.array(anchors[order][first].view(np.int64)), "n": pa.array(np.add.reduceat(1 + twice[order], first).astype(np.int64))}
                if places:
                    place = np.zeros(len(order), LOCAL)
                    place["doc"], place["key"], place["start"], place["length"] = b.column(0).to_numpy()[rows[order]], b.column(1).to_numpy()[rows[order]], start[order], length[order]
                    cols["places"] = blobs(place, first)
                yield pa.RecordBatch.from_pydict(cols)

        return docs.mapInArrow(rows, "anchor long, n long" + ", places binary" * places)

    def spread(batches):
        for b in batches:
            places = b.column(2).to_pylist()
            local = np.frombuffer(b"".join(places), LOCAL)
            if not len(local):
                continue
            many = np.array([len(x) for x in places]) // LOCAL.itemsize
            place = np.zeros(len(local), PLACE)
            place["start"], place["length"] = local["start"], local["length"]
            place["anchor"], place["all"] = np.repeat(b.column(0).to_numpy(), many), np.repeat(np.minimum(b.column(1).to_numpy(), 2**62), many)
            order = np.lexsort((local["key"], local["doc"]))
            ids, keys = local["doc"][order], local["key"][order]
            first = documents(ids, keys)
            yield pa.RecordBatch.from_arrays([pa.array(ids[first]), pa.array(keys[first]), blobs(place[order], first)], names=["doc_id", "key", "runs"])

    table = scratch.write(emit(True)) if kept else None
    counted = (table if kept else emit(False)).groupBy("anchor").agg(F.sum("n").alias("all")).filter("all > 1")
    often = scratch.write(counted)
    scratch.free_shuffles()
    most = often.agg(F.max("all")).first()[0] or 0
    anchors = Bloom(often)
    found = anchors.wanted(table) if kept else emit(True, anchors.among)
    found = found.join(often, "anchor").select("anchor", "all", "places").mapInArrow(spread, "doc_id long, key long, runs binary")
    found = scratch.write(found.groupBy("doc_id", "key").agg(F.collect_list("runs").alias("runs")))
    for done in (table, often) if kept else (often,):
        scratch.drop(done)
    scratch.free_shuffles()
    some = scratch.write(Bloom(found).wanted(docs).filter("text is not null").join(found, ["doc_id", "key"]).select("doc_id", "key", "text", "runs"))
    scratch.drop(found)
    scratch.free_shuffles()
    return some, most


LOCAL = np.dtype([("doc", "<i8"), ("key", "<i8"), ("start", "<i4"), ("length", "<i4")])
PLACE = np.dtype([("anchor", "<i8"), ("all", "<i8"), ("start", "<i4"), ("length", "<i4")])


def blobs(records: np.ndarray, first: np.ndarray) -> pa.Array:
    """One binary value for each stretch of records that begins at ``first``."""
    ends = (np.append(first, len(records)) * records.dtype.itemsize).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(records.tobytes())]).cast(pa.binary())


def held_twice(grams: np.ndarray, anchors: np.ndarray, start: np.ndarray, length: np.ndarray, span: int) -> np.ndarray:
    """For runs of windows of ``span`` grams: 1 where the anchor is at two places or more of them."""
    size = length + span - 1
    at = ragged(start, size)
    hits = grams[at] == np.repeat(anchors, size)
    return (np.add.reduceat(hits.astype(np.int64), np.cumsum(size) - size) > 1).astype(np.int64) if len(start) else np.zeros(0, np.int64)


def documents(ids: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where the runs of equal pairs begin."""
    return np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1]))))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, key, text: what tells a document from others. A null doc_id is the smallest number. key is 0 where doc_id tells enough, else a hash of the text:
    for null ids, and for all rows if any two share an id; rows equal in id and text are one document."""
    docs = need(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    shared = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count()
    key = F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseOR(F.lit(1))  # never 0, the key of a document told by its id
    return docs.select(F.coalesce("doc_id", F.lit(NONE)).alias("doc_id"), (key if shared else F.when(F.col("doc_id").isNull(), key).otherwise(F.lit(0).cast("long"))).alias("key"), "text", F.col("doc_id").alias("given"))


def unpacked(runs: list[bytes]) -> np.ndarray:
    """The places, by start."""
    a = np.frombuffer(b"".join(runs), PLACE)
    return np.unique(a) if len(a) else a


def merged(starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal intervals covered by windows of ``width`` that begin at the ascending starts: begins and ends."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.flatnonzero(np.diff(starts) > width)
    return starts[np.concatenate(([0], new + 1))], starts[np.append(new, len(starts) - 1)] + width

"""Operator 1, near-dedup by b-bit MinHash.

Each document's distinct word shingles give ``perms`` minima. Bands of whole minima name the buckets in
which candidates meet; of each minimum only the low ``bits`` bits are kept, packed, and the share of equal
ones, corrected for chance, estimates the similarity of candidates. Those not far below the threshold
are confirmed on the full shingle sets, and confirmed links joined to components.

Scale: documents with one and the same shingle set are a class with one representative from the
start, so that copies cost one row each. Within a bucket not all pairs become rows: a spanning forest of
the highest estimates is tried first; then the full sets of members that may still be linked across
components meet in their bucket, and only links that join components leave it. Large buckets are dealt
as pairs of blocks. Many links are joined by large-star and small-star steps in Spark.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LAST, Bloom, Scratch, mix, need, rolling, row_key, staying, tune
from .words import ragged, words

#: Odd multipliers and offsets of the permutations: a fixed sequence.
SEEDS = mix(np.arange(1, 513, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def bands_for(threshold: float, perms: int, miss: float = 1e-6) -> tuple[int, int]:
    """Rows of a band and number of bands: the longest bands that miss a pair at the threshold with a lower probability."""
    rows = max(r for r in range(1, 9) if r == 1 or (1 - threshold**r) ** (perms // r) <= miss)
    return rows, perms // rows


def shingle_sets(col: pa.Array, size: int):
    """The ascending distinct shingle hashes of each text."""
    for w in words(col, lower=True):
        grams = mix(rolling(w.hash, size))
        for d in range(w.n):
            a, b = int(w.cut[d]), int(w.cut[d + 1])
            if b - a >= size:
                yield np.unique(grams[a : b - size + 1])
            elif b > a:  # the whole sequence is one
                yield mix(rolling(w.hash[a:b], b - a) + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)


def set_key(s: np.ndarray) -> tuple[int, int, int]:
    return len(s), int(s.sum(dtype=np.uint64).view(np.int64)), int(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).view(np.int64))


def signatures(size: int, perms: int, bits: int, rows: int, bands: int):
    mult, add = SEEDS[:perms] | np.uint64(1), SEEDS[256 : 256 + perms]
    salt = mix(np.arange(bands, dtype=np.uint64) + np.uint64(77))
    per = 64 // bits

    def made(batches):
        for b in batches:
            n = len(b.column(0))
            minima = np.full((n, perms), 0xFFFFFFFF, np.uint64)
            keys = []
            with np.errstate(over="ignore"):
                for d, s in enumerate(shingle_sets(b.column(1), size)):
                    keys.append(set_key(s))
                    for k in range(0, len(s), 1024):
                        part = ((s[k : k + 1024, None] * mult + add) >> np.uint64(32)).min(axis=0)
                        np.minimum(minima[d], part, out=minima[d])
                low = minima & np.uint64((1 << bits) - 1)
                packed = np.zeros((n, -(-perms // per)), np.uint64)
                for j in range(perms):
                    packed[:, j // per] |= low[:, j] << np.uint64(j % per * bits)
                band = np.zeros((n, bands), np.uint64)
                for r in range(rows):
                    band = mix(band * np.uint64(0x9E3779B97F4A7C15) + minima[:, r : rows * bands : rows] + salt)
            width = packed.shape[1] * 8
            sig = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), n, [None, pa.py_buffer(packed.tobytes())]).cast(pa.binary())
            cuts = pa.array(np.arange(n + 1, dtype=np.int32) * bands)
            count, s1, s2 = (pa.array([k[i] for k in keys], pa.int64()) for i in range(3))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), count, s1, s2, sig, pa.ListArray.from_arrays(cuts, pa.array(band.view(np.int64).ravel()))], names=["doc_id", "text_key", "n", "s1", "s2", "sig", "bands"])

    return made


def estimates(a: np.ndarray, b: np.ndarray, perms: int, bits: int) -> np.ndarray:
    """Similarities by bit counts of packed signatures (last axis: words), corrected for equal low bits of unequal minima."""
    x = a ^ b
    for k in range(1, bits):
        x = x | (a ^ b) >> np.uint64(k)
    lowest = sum(1 << k for k in range(0, 64, bits))
    differ = np.bitwise_count(x & np.uint64(lowest)).sum(axis=-1, dtype=np.int64)
    chance = 1 / (1 << bits)
    return ((1 - differ / perms) - chance) / (1 - chance)


def whole(batches):
    """Tables of whole groups of one (bucket, block), from rows sorted by these."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([held, t]) if held is not None else t
        bucket, block = t["bucket"].to_numpy(), t["block"].to_numpy()
        edge = np.flatnonzero((bucket[1:] != bucket[:-1]) | (block[1:] != block[:-1])) + 1
        last = int(edge[-1]) if len(edge) else 0
        if last:
            yield t.slice(0, last).combine_chunks()
        held = t.slice(last)  # its group may go on
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def groups(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the groups of one (bucket, block)."""
    bucket, block = t["bucket"].to_numpy(), t["block"].to_numpy()
    start = np.flatnonzero(np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (block[1:] != block[:-1]))))
    return start, np.diff(np.append(start, len(bucket)))


def signature_words(t: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint64).reshape(t.num_rows, -1)


def forest(perms: int, bits: int, least: float):
    """For each group a spanning forest of the highest estimates of ``least`` or more, as pairs."""

    def tree(cid, sig):
        best, by, left = np.full(len(cid), -1.0), np.zeros(len(cid), np.int64), np.ones(len(cid), bool)
        k = 0
        while True:
            left[k] = False
            if not left.any():
                return
            e = estimates(sig[k], sig, perms, bits)
            better = e > best
            best[better], by[better] = e[better], k
            k = int(np.argmax(np.where(left, best, -2)))
            if best[k] >= least:
                yield int(cid[by[k]]), int(cid[k])

    def pairs(batches):
        for t in whole(batches):
            cid, sig = t["cid"].to_numpy(), signature_words(t)
            start, size = groups(t)
            two = start[size == 2]
            two = two[estimates(sig[two], sig[two + 1], perms, bits) >= least]
            found = {(int(cid[k]), int(cid[k + 1])) for k in two}
            for a, n in zip(start[size > 2].tolist(), size[size > 2].tolist(), strict=True):
                found.update((min(p), max(p)) for p in tree(cid[a : a + n], sig[a : a + n]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return pairs


def candidates(n: np.ndarray, comp: np.ndarray, sig: np.ndarray, threshold: int, perms: int, bits: int, least: float):
    """For each member of a group outside its largest component, those of other components that may be linked with it; each
    pair once. ``comp`` may change on the way."""
    names, count = np.unique(comp, return_counts=True)
    minor = comp != names[count.argmax()]
    order = np.arange(len(n))
    for i in np.flatnonzero(minor):
        may = (comp != comp[i]) & (100 * np.minimum(n, n[i]) >= threshold * np.maximum(n, n[i])) & (~minor | (order > i))
        k = np.flatnonzero(may)
        k = k[estimates(sig[i], sig[k], perms, bits) >= least]
        if len(k):
            yield i, k


def undecided(threshold: int, perms: int, bits: int, least: float):
    """The rows of groups that have a candidate in another component. Their bucket is named by the rows themselves, so that
    those who meet in several bands are one group afterwards (groups whose names clash are joined, which loses no link)."""

    def rows(batches):
        for t in whole(batches):
            cid, n, comp, sig = t["cid"].to_numpy(), t["n"].to_numpy(), t["comp"].to_numpy(), signature_words(t)
            stays = np.zeros(t.num_rows, bool)
            name = np.zeros(t.num_rows, np.uint64)
            own = mix(cid.view(np.uint64))
            for a, m in zip(*(x.tolist() for x in groups(t)), strict=True):
                for i, k in candidates(n[a : a + m], comp[a : a + m], sig[a : a + m], threshold, perms, bits, least):
                    stays[a + i] = stays[a + k] = True
                name[a : a + m] = own[a : a + m][stays[a : a + m]].sum(dtype=np.uint64)
            at = t.column_names.index
            t = t.set_column(at("bucket"), "bucket", pa.array(name.view(np.int64))).set_column(at("block"), "block", pa.array(np.zeros(t.num_rows, np.int64)))
            yield from t.filter(pa.array(stays)).to_batches()

    return rows


def confirmed(threshold: int, perms: int, bits: int, least: float):
    """The links of each group that join its components, found on the full sets where the group is: no pair becomes a row but these."""

    def links(batches):
        for t in whole(batches):
            cid, n, comp, sig = t["cid"].to_numpy(), t["n"].to_numpy(), t["comp"].to_numpy().copy(), signature_words(t)
            lists = t["shingles"].combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            values, cuts = lists.flatten().to_numpy(), np.concatenate(([0], np.cumsum(n)))
            found: set[tuple[int, int]] = set()
            for a, m in zip(*(x.tolist() for x in groups(t)), strict=True):
                ids = np.unique(values[cuts[a] : cuts[a + m]], return_inverse=True)[1]
                mark = np.zeros(len(ids), bool)
                first, size, part = cuts[a : a + m] - cuts[a], n[a : a + m], comp[a : a + m]
                for i, k in candidates(size, part, sig[a : a + m], threshold, perms, bits, least):
                    own = ids[first[i] : first[i] + size[i]]
                    mark[own] = True
                    common = np.add.reduceat(mark[ids[ragged(first[k], size[k])]], np.cumsum(size[k]) - size[k], dtype=np.int64)
                    mark[own] = False
                    for j in k[100 * common >= threshold * (size[i] + size[k] - common)]:
                        if part[j] != part[i]:
                            part[part == part[j]] = part[i]
                            found.add((min(int(cid[a + i]), int(cid[a + j])), max(int(cid[a + i]), int(cid[a + j]))))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return links


#: Edges that one task joins by itself, in a few dozen megabytes.
FEW = 500_000


def united(batches):
    """node, comp of all edges of a partition by union-find."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x, y = find(x), find(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
    nodes = list(parent)
    if nodes:
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["node", "comp"])


def components(scratch: Scratch, edges: DataFrame, few: int = FEW) -> DataFrame:
    """node, comp: the least node that each node of the edges (a, b) reaches. At most ``few`` edges are joined in one task;
    more by alternating large-star and small-star steps (Kiveris et al., 2014), with the same result."""
    if edges.limit(few + 1).count() <= few:
        return edges.select("a", "b").coalesce(1).mapInArrow(united, "node long, comp long")
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct()
    before, old = None, None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = scratch.write(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long"))).first())
        if old is not None:
            scratch.drop(old)
        if now == before:
            break
        before, old = now, e
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def grouped(spark: SparkSession, docs: DataFrame, shingle: int, threshold: int, perms: int = 128, bits: int = 4, block: int = 1024) -> DataFrame:
    """doc_id and text_key (as row_key has them), n, least (the smallest doc_id of the component), grp (a number of the component; null without shingles): one row for each input row."""
    tune(spark, 1024)
    scratch = Scratch(spark, "minhash")
    rows, bands = bands_for(threshold / 100, perms)
    ident, text_key = row_key()
    docs = need(docs, "doc_id", "text").select(ident.alias("doc_id"), "text", text_key.alias("text_key"))
    sigs = scratch.write(docs.mapInArrow(signatures(shingle, perms, bits, rows, bands), "doc_id long, text_key long, n long, s1 long, s2 long, sig binary, bands array<long>"))
    # a class: all documents with one shingle set; its number is fixed by the written table
    key = ["n", "s1", "s2"]
    classes = sigs.filter("n > 0").groupBy(*key).agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    classes = scratch.write(classes.withColumn("cid", F.monotonically_increasing_id()))
    bucketed = classes.select("cid", F.explode("bands").alias("bucket"))
    often = bucketed.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    members = bucketed.join(often, "bucket").join(classes.select("cid", "n", "sig"), "cid")
    members = scratch.write(members.select("bucket", "m", "cid", "n", "sig").distinct())
    scratch.free_shuffles()
    # four and a half standard deviations of the estimate below the threshold
    t, c = threshold / 100, 1 / (1 << bits)
    e = c + (1 - c) * t
    least = t - 4.5 * (e * (1 - e) / perms) ** 0.5 / (1 - c)

    # first the forest of each block in itself
    n_blocks = F.ceil(F.col("m") / block)
    own = F.pmod(F.xxhash64("cid"), n_blocks)
    found = members.select("bucket", own.alias("block"), "cid", "sig").repartition("bucket", "block").sortWithinPartitions("bucket", "block", "cid")
    found = scratch.write(found.mapInArrow(forest(perms, bits, least), "a long, b long").distinct())
    comp: DataFrame | None = None
    # classes with no candidate in their own block of a bucket may have one only in another block of it
    nodes = found.select(F.explode(F.array("a", "b")).alias("cid")).union(members.filter(F.col("m") > block).select("cid")).distinct()
    nodes = scratch.write(nodes.join(classes.select("cid", F.col("rep").alias("doc_id"), *key), "cid").select("doc_id", *key, "cid"))
    if nodes.limit(1).count():
        wanted = Bloom(nodes)

        def full(batches, among=wanted.among):
            for b in batches:
                b = b.filter(pa.array(among(b.column(0).to_numpy())))
                got = list(shingle_sets(b.column(1), shingle))
                keys = [set_key(s) for s in got]
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([k[i] for k in keys], pa.int64()) for i in range(3)), pa.array([s.view(np.int64) for s in got], pa.list_(pa.int64()))], names=["doc_id", "n", "s1", "s2", "shingles"])

        sets = docs.select("doc_id", "text").mapInArrow(full, "doc_id long, n long, s1 long, s2 long, shingles array<long>").join(nodes, ["doc_id", *key])
        sets = scratch.write(sets.groupBy("doc_id", *key, "cid").agg(F.first("shingles").alias("shingles")).select("cid", "shingles"))
        scratch.free_shuffles()
        tested = found.join(sets.select(F.col("cid").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("cid").alias("b"), F.col("shingles").alias("y")), "b")
        tested = tested.select("a", "b", F.size(F.array_intersect("x", "y")).alias("common"), (F.size("x") + F.size("y")).alias("all"))
        links = scratch.write(tested.filter(100 * F.col("common") >= threshold * (F.col("all") - F.col("common"))).select("a", "b"))
        comp = scratch.write(components(scratch, links))
        scratch.free_shuffles()

        # then all that may still be linked, in buckets that meet more than one component
        now = members.drop("m").join(comp.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
        met = now.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("all"), F.min("comp").alias("c0"), F.max("comp").alias("c1"))
        met = met.filter("c0 != c1 and m > 2").select("bucket", F.greatest(F.ceil(F.col("m") / block), F.ceil(F.col("all") / (1024 * block))).alias("n_blocks"))
        own, n_blocks = F.pmod(F.xxhash64("cid"), F.col("n_blocks")), F.col("n_blocks")
        dealt = F.transform(F.sequence(F.lit(0).cast("long"), n_blocks - 1), lambda j: F.least(own, j) * n_blocks + F.greatest(own, j))
        now = now.join(met, "bucket").select("bucket", F.explode(dealt).alias("block"), "cid", "n", "comp", "sig")
        now = now.repartition("bucket", "block").sortWithinPartitions("bucket", "block", "cid")
        now = scratch.write(now.mapInArrow(undecided(threshold, perms, bits, least), now.schema).distinct())
        scratch.free_shuffles()
        left = now.join(sets, "cid").select("bucket", "block", "cid", "n", "comp", "sig", "shingles")
        left = left.repartition("bucket", "block").sortWithinPartitions("bucket", "block", "cid")
        more = scratch.write(left.mapInArrow(confirmed(threshold, perms, bits, least), "a long, b long").distinct())
        if more.limit(1).count():
            comp = scratch.write(components(scratch, links.union(more)))
        for done in (sets, now):
            scratch.drop(done)
    for done in (members, found, nodes):
        scratch.drop(done)
    scratch.free_shuffles()
    out = sigs.select("doc_id", "text_key", *key).join(classes.select(*key, "cid", "rep"), key, "left")
    if comp is None:
        out = out.withColumn("least", F.lit(None).cast("long")).withColumn("comp", F.lit(None).cast("long"))
    else:
        of = comp.join(classes.select(F.col("cid").alias("node"), "rep"), "node")
        of = of.select(F.col("node").alias("cid"), "comp").join(of.groupBy("comp").agg(F.min("rep").alias("least")), "comp")
        out = out.join(of.select("cid", "comp", "least"), "cid", "left")
    return out.select("doc_id", "text_key", "n", F.coalesce("least", "rep", "doc_id").alias("least"), F.coalesce("comp", "cid").alias("grp"))


def near_duplicates(spark: SparkSession, docs: DataFrame, shingle: int = 5, threshold: int = 80, block: int = 1024) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each input row. Documents are linked if 100 * intersection >= threshold * union.

    Null and empty texts, and those of white space alone, have no shingles and are linked with nothing. Rows that share a doc_id are
    documents of their own. A null doc_id orders behind all others; component_id is null only where no document of the component has an id, and a
    null doc_id is never kept. Texts of any length are read whole; a text's shingles must fit in one task. An empty table gives an empty result.
    Columns but doc_id and text play no part.
    """
    out = grouped(spark, docs, shingle, threshold, block=block)
    real = lambda c: F.when(F.col(c) != LAST, F.col(c))
    return out.select(real("doc_id").alias("doc_id"), F.col("n").alias("n_shingles"), real("least").alias("component_id"), ((F.col("doc_id") == F.col("least")) & (F.col("doc_id") != LAST)).alias("kept"))


def keep_one(spark: SparkSession, docs: DataFrame, shingle: int = 5, threshold: int = 80) -> DataFrame:
    """The documents of which one of each group stays, with all their columns: that of the smallest doc_id (null
    orders last; of several texts with that id, the one of the least hash). Texts without shingles stay, equal rows of them once."""
    scratch = Scratch(spark, "near")
    found = scratch.write(grouped(spark, docs, shingle, threshold))
    # one row a group, with the least of its rows
    first = found.filter("grp is not null").groupBy("grp").agg(F.min(F.struct("doc_id", "text_key")).alias("first"))
    told = found.join(first, "grp", "left")
    return staying(scratch, docs, told.select("doc_id", "text_key", F.coalesce(F.struct("doc_id", "text_key") == F.col("first"), F.lit(True)).alias("stays")))

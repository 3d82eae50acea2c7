"""All pairs of two tables, block against block: what a pair of blocks finds leaves its task, pairs that were only looked at never become rows.

Vectors are dealt to blocks by a hash, so that the memory of a task is that of two blocks and the products of a few hundred of their rows, whatever the tables hold. The work stays that of all
pairs; what is shuffled is each row once a block of the other side. Sets of trigrams are packed by size and kind instead, and packs meet in a Cartesian product, which shuffles each set a fixed number of times.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Scratch

#: Rows of a block at most; rows of the left block that are compared at once.
BLOCK, TILE = 16_384, 512
#: Bits of a signature; sets of a pack at most; groups of trigrams; the number of a trigram that has no short one.
BITS, MOST, GROUPS, REST = 1024, 4096, 8, 65_535
#: Sets of the sample at most; frequent trigrams whose company is counted in it.
SAMPLE, OFTEN = 2048, 3000
#: Sets of a tile; sets of the right that it is compared with at once; cells that are looked up at once.
STRIP, WIDE, LOOKUPS = 256, 2048, 1 << 20
#: Bits of a signature at least for each trigram that two sets have; the rest is left to counting.
SPAN = 0.85


def meet(left: DataFrame, right: DataFrame, pairs: int, compare, schema: str) -> DataFrame:
    """left and right have ``lb`` and ``rb``, the numbers of the blocks that meet; ``pairs``: about how many do. The number of tasks is named, as few bytes can be much work."""
    deal = lambda df: df.repartition(min(3 * pairs + 8, 4000), "lb", "rb").groupBy("lb", "rb")
    return deal(left).cogroup(deal(right)).applyInArrow(compare, schema)


def _types(*tables: tuple[DataFrame, list[str]]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for df, cols in tables for c in cols)


def _crossed(left: DataFrame, right: DataFrame, n_left: int, n_right: int) -> tuple[DataFrame, DataFrame, int]:
    """Every block of the left with every block of the right."""
    a, b = (max(1, math.ceil(n / BLOCK)) for n in (n_left, n_right))
    own = lambda df, n: F.pmod(F.xxhash64(*[c for c in df.columns]), F.lit(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    return left.withColumn("lb", own(left, a)).withColumn("rb", all_of(b)), right.withColumn("rb", own(right, b)).withColumn("lb", all_of(a)), a * b


def _by_length(col: pa.ChunkedArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, vectors of length 1 as rows) for each length that vectors have; zero vectors and those that hold a null are left out. Sums go from left to right, so that equal vectors give equal results."""
    col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], col.type)
    sizes, out = pc.list_value_length(col).to_numpy(zero_copy_only=False), []
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        x = col.take(pa.array(rows)).flatten()
        empty = x.is_null().to_numpy(zero_copy_only=False).reshape(len(rows), -1).any(axis=1) if size else np.ones(len(rows), bool)
        x = x.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)
        norm = np.zeros(len(rows))
        for d in range(x.shape[1]):
            norm += x[:, d] * x[:, d]
        good = ~empty & (norm > 0)
        out.append((rows[good], x[good] / np.sqrt(norm[good])[:, None]))
    return out


def nearest_pairs(queries: DataFrame, corpus: DataFrame, least: float, apart: tuple[str, str] | None = None, most: int | None = None, tie: str | None = None) -> DataFrame:
    """queries: v and more; corpus: w and more. All pairs of a cosine of ``least`` or more, with it as ``similarity``; with ``apart`` only those whose values in these two columns, numbers, differ.

    With ``most`` a pair of blocks gives that many of each row of queries, by similarity to nine places and then the smallest ``tie`` (a number): more can't be among the best of all.
    """
    queries, corpus = queries.filter("v IS NOT NULL"), corpus.filter("w IS NOT NULL")
    mine, other = [c for c in queries.columns if c != "v"], [c for c in corpus.columns if c != "w"]

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [(np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0))]
        number = lambda t, c: t[c].to_numpy()
        for lrows, x in _by_length(left["v"]):
            for rrows, y in _by_length(right["w"]):
                if not len(x) or not len(y) or x.shape[1] != y.shape[1]:
                    continue
                xt, yt = np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)
                for a in range(0, len(x), TILE):
                    s = x[a : a + TILE] @ yt
                    if apart:
                        s[number(left, apart[0])[lrows[a : a + TILE], None] == number(right, apart[1])[rrows][None, :]] = -np.inf
                    # products of matrices may differ in the last place with the place of a row: they choose, sums from left to right decide
                    low = np.full(len(s), least - 1e-9)
                    if most and most < s.shape[1]:
                        low = np.maximum(low, np.partition(s, s.shape[1] - most, axis=1)[:, s.shape[1] - most] - 2e-9)
                    i, j = np.nonzero(s >= low[:, None])
                    exact = np.zeros(len(i))
                    for d in range(len(xt)):
                        exact += xt[d, a + i] * yt[d, j]
                    keep = np.flatnonzero(exact >= least)
                    if most:
                        keep = keep[np.lexsort((number(right, tie)[rrows[j[keep]]], -np.round(exact[keep], 9), i[keep]))]
                        begin = np.searchsorted(i[keep], i[keep])
                        keep = keep[np.arange(len(keep)) - begin < most]
                    found.append((lrows[a + i[keep]], rrows[j[keep]], exact[keep]))
        i, j, s = (np.concatenate(c) for c in zip(*found, strict=True))
        return pa.table({**{c: left[c].take(pa.array(i)) for c in mine}, **{c: right[c].take(pa.array(j)) for c in other}, "similarity": s})

    left, right, pairs = _crossed(queries, corpus, queries.count(), corpus.count())
    return meet(left, right, pairs, compare, _types((queries, mine), (corpus, other)) + ", similarity double")


def nearest_of_groups(queries: DataFrame, corpus: DataFrame, group: str, least: float) -> DataFrame:
    """queries: ``group`` and v; corpus: w and more. For each row of the corpus and each group the largest cosine with a vector of the group, if it is ``least`` or more, as ``similarity``; told once a pair of blocks."""
    queries, corpus = queries.select(group, "v").filter("v IS NOT NULL"), corpus.filter("w IS NOT NULL")
    other = [c for c in corpus.columns if c != "w"]

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [(np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0))]
        labels = pc.dictionary_encode(left[group].combine_chunks(), null_encoding="encode")
        codes = labels.indices.to_numpy(zero_copy_only=False)
        for lrows, x in _by_length(left["v"]):
            order = np.argsort(codes[lrows], kind="stable")
            own, begins = np.unique(codes[lrows][order], return_index=True)
            xt = np.ascontiguousarray(x[order].T)
            for rrows, y in _by_length(right["w"]):
                if not len(x) or not len(y) or x.shape[1] != y.shape[1]:
                    continue
                for a in range(0, len(y), TILE):
                    best = np.maximum.reduceat(y[a : a + TILE] @ xt, begins, axis=1)
                    i, j = np.nonzero(best >= least)
                    found.append((rrows[a + i], own[j], best[i, j]))
        i, g, s = (np.concatenate(c) for c in zip(*found, strict=True))
        return pa.table({group: labels.dictionary.take(pa.array(g)), **{c: right[c].take(pa.array(i)) for c in other}, "similarity": s})

    left, right, pairs = _crossed(queries, corpus, queries.count(), corpus.count())
    return meet(left, right, pairs, compare, _types((queries, [group]), (corpus, other)) + ", similarity double")


def _sets(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, trigrams of all rows as numbers): a text holds its row's distinct trigrams, three code points each, one behind the other."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    points = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), "<u4").astype(np.uint64).reshape(-1, 3)
    return pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) // 3, points[:, 0] << np.uint64(42) | points[:, 1] << np.uint64(21) | points[:, 2]


def _hashed(items: np.ndarray) -> np.ndarray:
    return ((items * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64)


class Book:
    """How trigrams are written: what a sample of the sets (``texts``) shows of them. It decides how fast sets are compared and never which of them are similar.

    codes: trigrams that have a short number, in order; bit: the bit of a signature that each of them turns over; group: the group that each is counted in, GROUPS if none.
    """

    def __init__(self, texts: pa.ChunkedArray):
        sizes, items = _sets(texts)
        codes, at, n = np.unique(items, return_inverse=True, return_counts=True)
        self.codes = np.sort(codes[np.argsort(-n, kind="stable")[:REST]])
        self.bit, self.group = _hashed(self.codes), np.full(len(self.codes), GROUPS)
        often = np.argsort(-n, kind="stable")[: min(OFTEN, REST)]
        place = np.full(len(codes), -1)
        place[often] = np.arange(len(often))
        row, col = np.repeat(np.arange(len(sizes)), sizes), place[at]
        x = np.zeros((len(sizes), len(often)), np.float32)
        x[row[col >= 0], col[col >= 0]] = 1
        own = np.searchsorted(self.codes, codes[often])
        self.bit[own], self.group[own] = self._bits(x), self._groups(x)

    @staticmethod
    def _bits(x: np.ndarray) -> np.ndarray:
        """Trigrams that seldom stand in one set share a bit; those of a bit of the signature folded to half its length part when it is unfolded."""
        both = x.T @ x
        np.fill_diagonal(both, 0)
        at, n = np.zeros(len(both), np.int64), BITS >> 3
        while n <= BITS:
            met = np.zeros((n, len(both)), np.float32)
            for k in range(len(both)):
                choice = np.arange(n) if n == BITS >> 3 else np.array([at[k], at[k] + n // 2])
                at[k] = choice[np.argmin(met[choice, k])]
                met[at[k]] += both[k]
            n *= 2
        return at

    @staticmethod
    def _groups(x: np.ndarray) -> np.ndarray:
        """The cluster of sets (by cosine) in which a trigram is most frequent."""
        unit = lambda v: v / np.maximum(np.sqrt((v * v).sum(axis=-1, keepdims=True)), 1e-9)
        y = unit(x)
        centre = y[:1]
        while len(centre) < GROUPS:
            centre = np.vstack([centre, y[[np.argmin((y @ centre.T).max(axis=1))]]])
        for _ in range(8):
            at = (y @ centre.T).argmax(axis=1)
            centre = unit(np.stack([y[at == g].sum(axis=0) for g in range(GROUPS)]))
        return np.stack([x[at == g].sum(axis=0) / max((at == g).sum(), 1) for g in range(GROUPS)]).argmax(axis=0)

    def written(self, texts: pa.ChunkedArray) -> dict[str, pa.Array]:
        """Columns of the sets: size, the group of most trigrams (label) and their number (own), numbers of trigrams by group, short numbers (REST for a trigram without one), trigrams without one, signature."""
        sizes, items = _sets(texts)
        at = np.minimum(np.searchsorted(self.codes, items), len(self.codes) - 1)
        known = self.codes[at] == items
        bit, group = np.where(known, self.bit[at], _hashed(items)), np.where(known, self.group[at], GROUPS)
        row, ends = np.repeat(np.arange(len(sizes)), sizes), np.concatenate([[0], np.cumsum(sizes)])
        counts = np.bincount(row * (GROUPS + 1) + group, minlength=len(sizes) * (GROUPS + 1)).reshape(len(sizes), GROUPS + 1)[:, :GROUPS].astype(np.int32)
        signature = np.empty((len(sizes), BITS // 8), np.uint8)
        for a in range(0, len(sizes), STRIP):
            b = min(a + STRIP, len(sizes))
            n = np.bincount((row[ends[a] : ends[b]] - a) * BITS + bit[ends[a] : ends[b]], minlength=(b - a) * BITS)
            signature[a:b] = np.packbits((n.reshape(-1, BITS) & 1).astype(bool), axis=1, bitorder="little")
        rests = np.concatenate([[0], np.cumsum(~known)])[ends]
        cut = lambda data, ends: pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
        fixed = lambda data: cut(data, np.arange(len(sizes) + 1) * data[:1].nbytes)
        label = counts.argmax(axis=1)
        return {
            "label": pa.array(label, pa.int32()),
            "size": pa.array(sizes, pa.int32()),
            "own": pa.array(counts[np.arange(len(sizes)), label]),
            "counts": fixed(counts),
            "ids": cut(np.where(known, at, REST).astype(np.uint16), ends * 2),
            "rest": cut(items[~known], rests * 8),
            "signature": fixed(signature),
        }


#: Columns of a set as Book.written gives them, and of a pack of sets.
SET = "label int, size int, own int, counts binary, ids binary, rest binary, signature binary"
PACK = "least int, most int, low array<int>, high array<int>, sizes binary, counts binary, ids binary, rest binary, signature binary"


def _tiled(counts: np.ndarray) -> np.ndarray:
    """Places of sets in an order by which tiles hold like ones: halves by the group in which the numbers of trigrams differ most."""
    if len(counts) <= STRIP:
        return np.arange(len(counts))
    order = np.argsort(counts[:, counts.std(axis=0).argmax()], kind="stable")
    half = math.ceil(len(order) / STRIP) // 2 * STRIP
    return np.concatenate([part[_tiled(counts[part])] for part in (order[:half], order[half:])])


def _pack(sets: pa.Table) -> pa.RecordBatch:
    sets = sets.take(pa.array(_tiled(np.frombuffer(b"".join(sets["counts"].to_pylist()), np.int32).reshape(-1, GROUPS))))
    sizes = sets["size"].to_numpy()
    joined = {c: b"".join(sets[c].to_pylist()) for c in ("counts", "ids", "rest", "signature")}
    counts = np.frombuffer(joined["counts"], np.int32).reshape(-1, GROUPS)
    keys = sets["key"].combine_chunks()
    one = {"keys": pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), "least": [sizes.min()], "most": [sizes.max()], "low": [counts.min(axis=0)], "high": [counts.max(axis=0)]}
    types = {"least": pa.int32(), "most": pa.int32(), "low": pa.list_(pa.int32()), "high": pa.list_(pa.int32())}
    one = {c: v if c == "keys" else pa.array(v, types[c]) for c, v in one.items()} | {"sizes": pa.array([sizes.astype(np.int32).tobytes()])}
    return pa.RecordBatch.from_pydict(one | {c: pa.array([v], pa.binary()) for c, v in joined.items()})


def _packs(sets: DataFrame, book: Book, rows: int, n: int) -> DataFrame:
    """One row a pack of at most ``rows`` of the ``n`` sets (key, grams) that are alike in size and groups."""
    kind = sets.schema["key"].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict({"key": batch["key"], **book.written(batch["grams"])})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, new]) if held else new
            while held.num_rows >= rows:
                yield _pack(held.slice(0, rows))
                held = held.slice(rows)
        if held and held.num_rows:
            yield _pack(held)

    order = ["label", "size", "own", F.xxhash64("key")]
    out = sets.mapInArrow(write, f"key {kind}, {SET}").repartitionByRange(max(1, min(math.ceil(n / rows / 4), 2000)), *order).sortWithinPartitions(*order)
    return out.mapInArrow(cut, f"keys array<{kind}>, {PACK}").withColumn("pack", F.monotonically_increasing_id())


class _Opened:
    """A pack in a task, with bounds of its tiles of STRIP sets."""

    def __init__(self, batch: pa.RecordBatch, side: str, row: int, slack: float):
        read = lambda c, kind: np.frombuffer(batch[side + c][row].as_buffer(), kind)
        self.keys = batch[side + "keys"][row].values
        self.sizes, self.counts = read("sizes", np.int32).astype(np.int64), read("counts", np.int32).reshape(-1, GROUPS)
        self.ids, self.rest = read("ids", np.uint16), read("rest", np.uint64)
        self.ends = np.concatenate([[0], np.cumsum(self.sizes)])
        self.allowed = np.minimum(np.ceil(slack * self.sizes), BITS)
        begins = np.arange(0, len(self.sizes), STRIP)
        self.least, self.most = np.minimum.reduceat(self.sizes, begins), np.maximum.reduceat(self.sizes, begins)
        self.low, self.high = np.minimum.reduceat(self.counts, begins, axis=0), np.maximum.reduceat(self.counts, begins, axis=0)
        self.words, self.signs = read("signature", np.uint64).reshape(len(self.sizes), -1), {}

    def folded(self, bits: int, left: bool) -> np.ndarray:
        """Signatures of so many bits as numbers, and two more columns: of a row of the left and one of the right, the product is 0 or more if they differ in no more places than both allow."""
        if bits not in self.signs:
            words = self.words
            while words.shape[1] * 64 > bits:
                words = words[:, : words.shape[1] // 2] ^ words[:, words.shape[1] // 2 :]
            out = np.ones((len(words), bits + 2), np.float32)
            out[:, :bits] = np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1, bitorder="little")
            out[:, bits if left else bits + 1] = (self.allowed - np.bitwise_count(words).sum(axis=1)) / 2
            self.signs[bits] = out
        return self.signs[bits]

    def items(self, rest: np.ndarray) -> np.ndarray:
        """Short numbers, from REST on by the place in ``rest`` of trigrams that have none."""
        out = self.ids.astype(np.int64)
        out[out == REST] += np.searchsorted(rest, self.rest)
        return out


def _close(x: np.ndarray, y: np.ndarray, room: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of folded signatures that differ in no more places than both allow."""
    product, fits = (r[: len(x) * len(y)].reshape(len(x), len(y)) for r in room)
    np.matmul(x, y.T, out=product)
    np.greater_equal(product, 0, out=fits)
    flat = fits.reshape(-1)
    if flat.size % 8:
        at = np.flatnonzero(flat)
    else:
        # few fit: look at eight at once
        at = (np.flatnonzero(flat.view(np.uint64))[:, None] * 8 + np.arange(8)).reshape(-1)
        at = at[flat[at]]
    return at // len(y), at % len(y)


def _alike(x: _Opened, y: _Opened, threshold: float, same: bool, room: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, similarity) of the sets whose Jaccard similarity reaches the threshold, tile by tile of the left; with ``same`` both sides are one pack, and i < j.

    Similar sets differ in (1 - t) / (1 + t) of the sum of their sizes at most; the numbers of their trigrams by group differ by no more in sum, and neither do their signatures, also
    folded. Tiles and then pairs beyond that are dropped without loss. The common trigrams of the others are counted.
    """
    slack = (1 - threshold) / (1 + threshold)
    rest, items = None, ()
    for k, a in enumerate(range(0, len(x.sizes), STRIP)):
        b = min(a + STRIP, len(x.sizes))
        apart = np.maximum(0, np.maximum(x.low[k] - y.high, y.low - x.high[k])).sum(axis=1)
        near = (apart <= slack * (x.most[k] + y.most) + 1e-6) & (threshold * x.least[k] <= y.most + 1e-6) & (threshold * y.least <= x.most[k] + 1e-6)
        if same:
            near[:k] = False
        bits = np.where(near, np.minimum(BITS, np.maximum(BITS >> 3, 1 << np.ceil(np.log2(SPAN * (x.most[k] + y.most))).astype(np.int64))), 0)
        edges, pairs = np.flatnonzero(np.diff(bits, prepend=0, append=0)), [(np.zeros(0, "i8"), np.zeros(0, "i8"))]
        for first, end in zip(edges[:-1], edges[1:], strict=True):
            for c in range(first * STRIP, min(end * STRIP, len(y.sizes)), WIDE) if bits[first] else ():
                i, j = _close(x.folded(int(bits[first]), True)[a:b], y.folded(int(bits[first]), False)[c : min(c + WIDE, end * STRIP)], room)
                pairs.append((i, c + j))
        i, j = (np.concatenate(c) for c in zip(*pairs, strict=True))
        fits = np.minimum(x.sizes[a + i], y.sizes[j]) >= threshold * np.maximum(x.sizes[a + i], y.sizes[j]) - 1e-9
        if same:
            fits &= a + i < j
        i, j = i[fits], j[fits]
        if not len(i):
            continue
        if rest is None:
            rest = np.unique(np.concatenate([x.rest, y.rest]))
            items = x.items(rest), y.items(rest)
        # a column for each trigram of the tile; column 0 stands for all others
        mine = items[0][x.ends[a] : x.ends[b]]
        column = np.zeros(REST + len(rest) + 1, np.int32)
        column[mine] = 1
        width = int(column.sum()) + 1
        column *= np.cumsum(column, dtype=np.int32)
        table = np.zeros((b - a, width), bool)
        table[np.repeat(np.arange(b - a), x.sizes[a:b]), column[mine]] = True
        order = np.argsort(j, kind="stable")
        i, j, p = i[order], j[order], 0
        while p < len(i):
            # rows of equal length, so many that they stay small
            q = min(len(i), p + max(1, LOOKUPS // int(y.sizes[j[p]])))
            while q > p + 1 and (q - p) * int(y.sizes[j[p:q]].max()) > 2 * LOOKUPS:
                q = p + (q - p) // 2
            rows, which = np.unique(j[p:q], return_inverse=True)
            long = y.sizes[rows]
            grid = np.zeros((len(rows), long.max()), np.int32)
            begin = np.cumsum(long) - long
            grid[np.arange(long.max()) < long[:, None]] = column[items[1][np.repeat(y.ends[rows] - begin, long) + np.arange(long.sum())]]
            common = table.reshape(-1)[grid[which] + (i[p:q] * width).astype(np.int32)[:, None]].sum(axis=1, dtype=np.int32).astype(np.int64)
            similarity = common / (x.sizes[a + i[p:q]] + y.sizes[j[p:q]] - common)
            good = similarity >= threshold
            yield a + i[p:q][good], j[p:q][good], similarity[good]
            p = q


def similar_sets(left: DataFrame, right: DataFrame, threshold: float, itself: bool = False) -> DataFrame:
    """a, b, similarity: keys of both sides (key, grams: distinct trigrams, one behind the other) whose sets have a Jaccard similarity of ``threshold`` or more; empty sets have none. ``itself``: both sides are one table, a < b.

    Sets are written short, with signatures, in packs of like size and like trigrams; packs that can hold similar sets meet in a Cartesian product. It reads packs where they were written or
    dealt once, so that what lies on disk is a few copies of the sets, however many packs meet, and the pairs that were found.
    """
    spark, scratch = left.sparkSession, Scratch(left.sparkSession, "similar")
    beside = lambda tables: list(scratch.write_all({str(i): t for i, t in enumerate(tables)}).values())
    told = beside([df.select("key", "grams").filter("length(grams) > 0") for df in ([left] if itself else [left, right])])
    counts = [t.count() for t in told]
    kinds = [df.schema["key"].dataType.simpleString() for df in (left, right)]
    schema = f"a {kinds[0]}, b {kinds[1]}, similarity double"
    if not all(counts):
        return spark.createDataFrame([], schema)
    book = Book(told[-1].orderBy(F.xxhash64("key")).limit(SAMPLE).select("grams").toArrow()["grams"])
    # a few packs would leave tasks without work
    sizes = [min(BLOCK, MOST, max(256, n // 48)) for n in counts]
    packs = beside([_packs(t, book, rows, n) for t, rows, n in zip(told, sizes, counts, strict=True)])

    def dealt(s: int, name: str) -> DataFrame:
        # tasks of a product are as many as the partitions of both sides multiplied; a partition of 16 packs stays small
        n = math.ceil(counts[s] / sizes[s])
        side = packs[s].select(*[F.col(c).alias(name + c) for c in packs[s].columns])
        return side.repartition(max(1, min(32, n // 4), math.ceil(n / 16)))

    slack = (1 - threshold) / (1 + threshold)
    x, y = dealt(0, "x_"), dealt(len(packs) - 1, "y_")
    gap = lambda g: F.greatest(F.lit(0), F.get("x_low", F.lit(g)) - F.get("y_high", F.lit(g)), F.get("y_low", F.lit(g)) - F.get("x_high", F.lit(g)))
    near = (sum((gap(g) for g in range(GROUPS)), F.lit(0)) <= slack * (F.col("x_most") + F.col("y_most")) + 1e-6) & (threshold * F.col("x_least") <= F.col("y_most") + 1e-6) & (threshold * F.col("y_least") <= F.col("x_most") + 1e-6)
    if itself:
        # which of two packs stands on the left is a toss, so that tasks have alike shares
        toss = F.xxhash64("x_pack").bitwiseXOR(F.xxhash64("y_pack")) % 2 == 0
        near &= (F.col("x_pack") == F.col("y_pack")) | ((F.col("x_pack") < F.col("y_pack")) == toss) & (F.col("x_pack") != F.col("y_pack"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        room, last = (np.empty(STRIP * WIDE, np.float32), np.empty(STRIP * WIDE, bool)), None
        for batch in batches:
            for row in range(batch.num_rows):
                # one pack of the left meets many
                pack = batch["x_pack"][row].as_py()
                if pack != last:
                    left, last = _Opened(batch, "x_", row, slack), pack
                right = _Opened(batch, "y_", row, slack)
                same = itself and batch["y_pack"][row].as_py() == pack
                for i, j, similarity in _alike(left, right, threshold, same, room):
                    if len(i):
                        yield pa.RecordBatch.from_pydict({"a": left.keys.take(pa.array(i)), "b": right.keys.take(pa.array(j)), "similarity": pa.array(similarity)})

    out = x.hint("shuffle_replicate_nl").join(y, near).mapInArrow(compare, schema)
    return scratch.write(out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity") if itself else out)

"""Operator 7, packing: shortest-pack-first over the length histogram (Krell et al., 2021).

Documents are tokenised, cut into full pieces of ``limit`` ids and a rest, and the rests are
packed by their histogram alone: lengths are placed longest first, each into the packs with the
least content that still has room, whole groups of equal packs at a time. The histogram has at most
``limit`` rows, so packing costs the same for any corpus. Patterns (pack contents with a count) are
joined back to the pieces by their rank among pieces of the same length.

Scale: one scan tokenises; what follows moves a few dozen bytes a piece. Ranks are local row numbers in
(length, salt) plus offsets of a small counting table, so that a length that a third of all pieces
share is dealt to many tasks.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, as_bytes, need, tune
from .words import ragged, words

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
_codecs: dict[str, WordCodec] = {}


class WordCodec:
    """Encodes texts word by word with a cache, to the same ids as encoding them whole.

    The vocabulary's normaliser lower-cases, collapses white space and composes characters, none of
    which reaches across a white-space byte, and its pre-tokeniser always cuts there. ASCII is
    lower-cased and lone stops are split off first, which makes fewer distinct words. Texts with the
    beginning of a special token are encoded whole, as are all if ``wordwise`` is false. The cache is
    keyed by 64-bit word hashes; when it holds ``room`` words it starts anew.
    """

    def __init__(self, path: str, room: int = 3_000_000, wordwise: bool = True):
        from tokenizers import Tokenizer

        self.tok, self.room, self.wordwise = Tokenizer.from_file(path), room, wordwise
        vocab = self.tok.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.keys, self.at, self.many = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 16, "<u4"), 0

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _miss(self, words: list[bytes]) -> list[np.ndarray]:
        """Words of letters alone are one pre-token each, so that many are encoded in one call and cut at word ends."""
        texts = [w.decode("utf-8", "replace") for w in words]
        plain = [k for k, t in enumerate(texts) if t.isalpha()]
        out: list = [None] * len(words)
        for at in range(0, len(plain), 100):
            part = plain[at : at + 100]
            ids = np.array(self.tok.encode_batch_fast([" ".join([texts[k] for k in part])], add_special_tokens=False)[0].ids, "<u4")
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) == len(part) and cut[-1] == len(ids):
                for k, x in zip(part, np.split(ids, cut[:-1]), strict=True):
                    out[k] = x
        rest = [k for k in range(len(words)) if out[k] is None]
        for k, x in zip(rest, self._whole([texts[k] for k in rest]), strict=True):
            out[k] = x
        return out

    def _learn(self, keys: np.ndarray, found: list[np.ndarray]) -> None:
        """keys: ascending, none known."""
        if len(self.keys) + len(keys) > self.room:
            self.clear()
        many = np.array([len(x) for x in found], np.int64)
        new, at = np.concatenate(found), self.used + np.cumsum(many) - many
        if self.used + len(new) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(max(self.used, len(new)) + len(new), "<u4")])
        self.ids[self.used : self.used + len(new)] = new
        self.used += len(new)
        to = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.many = np.insert(self.keys, to, keys), np.insert(self.at, to, at), np.insert(self.many, to, many)

    def _known(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.searchsorted(self.keys, h)
        k[k == len(self.keys)] = 0
        return (self.keys[k] == h if len(self.keys) else np.zeros(len(h), bool)), k

    def encode(self, col: pa.Array):
        """Chunks of documents: index of the first, ids of all as one array of little-endian unsigned 32-bit integers, and where each one's begin and end."""
        if not self.wordwise:
            found = self._whole([x.decode("utf-8", "replace") for x in as_bytes(col)])
            yield 0, np.concatenate([*found, np.zeros(0, "<u4")]), np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int64)
            return
        for w in words(col, lower=True, stops=True, size=1 << 21):
            unique, where, back = np.unique(w.hash, return_index=True, return_inverse=True)
            new = np.flatnonzero(~self._known(unique)[0])
            if len(new):
                self._learn(unique[new], self._miss([w.text(k) for k in where[new]]))
                if not self._known(unique)[0].all():  # it started anew
                    new = np.flatnonzero(~self._known(unique)[0])
                    self._learn(unique[new], self._miss([w.text(k) for k in where[new]]))
            k = self._known(unique)[1][back]
            many = self.many[k]
            ids = self.ids[ragged(self.at[k], many)]
            cut = np.concatenate(([0], np.cumsum(many)))[w.cut]
            if (special := np.flatnonzero((w.data[:-1] == 60) & (w.data[1:] == 124))).size:
                parts = [ids[a:b] for a, b in zip(cut, cut[1:], strict=False)]
                for d in np.unique(np.searchsorted(w.offsets, special, side="right") - 1):
                    parts[d] = self._whole([col[w.first + int(d)].as_py()])[0]
                ids, cut = np.concatenate(parts), np.concatenate(([0], np.cumsum([len(x) for x in parts]))).astype(np.int64)
            yield w.first, ids, cut


def codec(path: str, wordwise: bool) -> WordCodec:
    if path not in _codecs:
        _codecs[path] = WordCodec(path, wordwise=wordwise)
    return _codecs[path]


def pieces_of(docs: DataFrame, tokenizer: str, end_id: int, limit: int, wordwise: bool = True) -> DataFrame:
    """Pieces of at most ``limit`` ids with the checksum of their ids."""
    tokenizer_file = tokenizer
    tail = np.array([end_id], "<u4").tobytes()

    def cut(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        enc = codec(tokenizer_file, wordwise)
        for b in batches:
            doc_ids = b.column(0).to_pylist()
            for first, ids, at in enc.encode(b.column(1)):
                rows: list[tuple] = []
                for k in range(len(at) - 1):
                    own = ids[at[k] : at[k + 1]].tobytes() + tail
                    n = len(own) // 4
                    for x in range(0, n, limit):
                        piece = own[4 * x : 4 * (x + limit)]
                        rows.append((doc_ids[first + k], x, len(piece) // 4, zlib.crc32(piece), n))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return need(docs, "doc_id", "text").mapInArrow(cut, PIECES)


def shortest_pack_first(histogram: dict[int, int], limit: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in order of placement) with their counts. Lengths go longest first; each goes to the
    packs with the least content that still have room, as many of them at once as there are pieces."""
    open_: dict[int, list[list]] = {}  # content -> [[pattern, count], ...]
    sizes: list[int] = []  # contents of open packs, ascending

    def put(content: int, pattern: tuple, count: int) -> None:
        if content not in open_:
            sizes.insert(bisect_left(sizes, content), content)
            open_[content] = []
        open_[content].append([pattern, count])

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if not sizes or sizes[0] + length > limit:
                # no pack has room: new ones, several pieces to a pack where they fit
                each = limit // length
                for many, count in ((each, left // each), (left % each, 1)):
                    if many and count:
                        put(many * length, (length,) * many, count)
                break
            content = sizes[0]
            groups = open_[content]
            pattern, count = groups.pop()
            if not groups:
                sizes.pop(0)
                del open_[content]
            take = min(left, count)
            if take < count:
                put(content, pattern, count - take)
            put(content + length, (*pattern, length), take)
            left -= take
    return [(p, c) for s in sizes for p, c in open_[s]]


def placed(patterns: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For each slot of a pattern: its length, the first rank it takes, the first sequence, the offset in it."""
    used: dict[int, int] = {}
    rows, seq = [], 0
    for pattern, count in patterns:
        offset = 0
        slots: dict[int, int] = {}
        for length in pattern:
            slots[length] = slots.get(length, 0) + 1
            rows.append((length, used.get(length, 0), seq, offset))
            used[length] = used.get(length, 0) + count
            offset += length
        seq += count
    rows.sort()
    a = np.array(rows or [(0, 0, 0, 0)], np.int64)
    return {"length": a[:, 0], "rank": a[:, 1], "seq": a[:, 2], "offset": a[:, 3]}


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 2, limit: int = 4096, wordwise: bool = True) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row for each piece.

    A null or empty text is the end id alone. Rows that share a doc_id are packed each for itself.
    An empty table gives no rows. ``wordwise`` holds for vocabularies that cut at white space.
    """
    tune(spark, 512)
    scratch = Scratch(spark, "pack")
    pieces = scratch.write(pieces_of(docs, tokenizer, end_id, limit, wordwise))
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most limit rows
    slots = placed(shortest_pack_first(histogram, limit))
    salts = max(16, sum(histogram.values()) // 200_000)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)))
    before = salted.groupBy("length", "salt").count()
    before = before.select("length", "salt", (F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")).alias("before"))
    local = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32"))
    ranked = salted.withColumn("rn", local).join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("rn") - 1)

    def place(batches):
        keys = slots["length"] * (1 << 48) + slots["rank"]
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            k = np.searchsorted(keys, length * (1 << 48) + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.array(slots["seq"][k] + rank - slots["rank"][k]), pa.array(slots["offset"][k])], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("rank").cast("long").alias("rank")).mapInArrow(place, PIECES + ", sequence_id long, offset long")

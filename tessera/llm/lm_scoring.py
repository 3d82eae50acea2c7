"""Operator 3, language-model scoring: a gated recurrent model (gru.py) over the most frequent words, with exact counts for all others.

The model's vocabulary is the most frequent training tokens, the end among them, as many as cover the share
``coverage`` of the training text, so that it grows with the input (``vocabulary`` sets a number instead), and one
token for all others, which then get their share of the additively smoothed unigram distribution: the
model is a distribution over all texts. Of the training documents one in 64 is kept back; all others are learnt from: each task trains from
the same weights on its own documents of a part, the weights are averaged by tokens, and the next part goes on from there. Those weights stay
that score the documents kept back best, the unigram start among them.

Scale: counts of all words are gathered by 64-bit word hashes with map-side sums. The counts of the some ``head`` most
frequent (a fixed bound) go with the tasks; occurrences of all others are joined with the count table.
Documents are scored where they are read, in memory bounded by ``flush`` tokens a task and one document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, need, tune
from .gru import NAMES, Gru, classes_for, init
from .words import words

END = 0x0E0D0E0D0E0D0E0D  # stands for the end of a text among word hashes


def held_out(fold: int, of: int) -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % of == fold, F.lit(False))


def token_counts(docs: DataFrame) -> DataFrame:
    """h, c: occurrences of each token, ends included."""

    def count(batches):
        for b in batches:
            col = b.column(0)
            found = [w.hash for w in words(col, lower=True)]
            keys, n = np.unique(np.concatenate([*found, np.full(len(col), END, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "c"])

    return docs.select("text").mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


class Vocabulary:
    """Model numbers of the most frequent tokens and counts of the head."""

    def __init__(self, head: np.ndarray, counts: np.ndarray, total: int, distinct: int, size: int, classes: int):
        """head: hashes with their counts, most frequent first."""
        self.total, self.distinct = total, distinct
        order = np.argsort(head)
        self.keys, self.counts = head[order], counts[order]
        # hashes are spread evenly: the first bits tell where to look
        self.bits = max(1, len(head).bit_length())
        self.first = np.searchsorted(self.keys >> np.uint64(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=np.uint64))
        self.tries = int(np.diff(self.first).max(initial=0))
        own = head[: size - 2]
        if END not in own.tolist():
            own = np.append(own, np.uint64(END))
        own_counts = self.count(own)
        mass = np.append(own_counts, max(1, total - own_counts.sum())).astype(float)
        order, self.bounds = classes_for(mass, classes)
        self.mass = mass[order]
        number = np.empty(len(mass), np.int64)
        number[order] = np.arange(len(mass))
        self.other, self.size = int(number[-1]), len(mass)
        by = np.argsort(own)
        self.own, self.number = own[by], number[:-1][by]
        self.end = int(self.number[np.searchsorted(self.own, np.uint64(END))])
        # what is left of the unigram distribution for tokens that the model does not know
        self.rest = 1 - float((10.0 ** self.unigram(self.count(self.own))).sum())

    def count(self, h: np.ndarray) -> np.ndarray:
        """0 beyond the head."""
        out = np.zeros(len(h), np.int64)
        bucket = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.first[bucket], self.first[bucket + 1]
        left = np.flatnonzero(at < end)
        for _ in range(self.tries):
            k = at[left]
            hit = self.keys[k] == h[left]
            out[left[hit]] = self.counts[k[hit]]
            at[left] += 1
            left = left[~hit & (k + 1 < end[left])]
            if not len(left):
                break
        return out

    def unigram(self, c: np.ndarray) -> np.ndarray:
        """log10 of the smoothed probability of a token with such a count."""
        return np.log10((c + 0.1) / (self.total + 0.1 * (self.distinct + 1)))

    def ids(self, h: np.ndarray) -> np.ndarray:
        k = np.minimum(np.searchsorted(self.own, h), len(self.own) - 1)
        return np.where(self.own[k] == h, self.number[k], self.other).astype(np.int32)


def most_frequent(counts: DataFrame, head: int):
    """h, c of the most frequent tokens, by falling count and h: at most about ``head`` rows, found by a histogram of the counts, so that no partition sends a list of its own.
    Of the tokens with the count that does not fit as a whole, a share by their hashes."""
    exact = 1 << 14  # higher counts fall in steps of an eightieth
    step = F.when(F.col("c") < exact, F.col("c")).otherwise(exact + F.floor(F.log(F.col("c") / exact) * 80)).cast("long")
    histogram = sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True)  # some 17,000 rows
    room, least = head, None
    for r in histogram:
        if r["count"] > room:
            break
        room, least = room - r["count"], r["step"]
    else:
        r = None
    some = step >= (least if least is not None else 2**62)
    if r is not None:
        some |= (step == r["step"]) & (F.pmod("h", F.lit(1 << 20)) < int((1 << 20) * room / r["count"]))
    return counts.filter(some).toPandas().sort_values(["c", "h"], ascending=[False, True], ignore_index=True)


def size_for(counts: np.ndarray, total: int, coverage: float, least: int = 1024) -> int:
    """Size of a model vocabulary that covers a share of the training tokens. counts: of the head, most frequent first."""
    words_ = int(np.searchsorted(np.cumsum(counts), coverage * total)) + 1
    return max(least, min(words_, len(counts)) + 2)


def _pack(params: dict[str, np.ndarray]) -> bytes:
    return b"".join(params[n].astype("<f4").tobytes() for n in NAMES)


def _unpack(raw: bytes, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for n in NAMES:
        size = like[n].size * 4
        out[n] = np.frombuffer(raw[at : at + size], "<f4").reshape(like[n].shape).copy()
        at += size
    return out


def train(docs: DataFrame, vocab: Vocabulary, hidden: int, lanes: int, window: int, rate: float, flush: int, rounds: int, merge: int = 8, kept: int = 64) -> dict[str, np.ndarray]:
    """Weights learnt from the documents once, in ``rounds`` parts of them: after each part the tasks' weights, and their step sizes, are averaged by tokens and go out again.
    Of the weights at the start (the unigram distribution) and after each part, those are kept that score the documents kept back for it, one in ``kept``, best."""
    weights = init(vocab.mass, vocab.bounds, hidden)
    tried = [weights]
    slopes: dict[str, np.ndarray] | None = None
    schema = "state binary, seen long"

    def learn(weights, slopes):
        def rows(batches):
            model, seen = Gru({n: v.copy() for n, v in weights.items()}, vocab.bounds), 0
            if slopes:
                model.grad2 = {n: v.copy() for n, v in slopes.items()}
            held, size = [], 0
            for b in batches:
                for w in words(b.column(0), lower=True):
                    held += np.split(vocab.ids(w.hash), w.cut[1:-1])
                    size += len(w.hash) + w.n
                    if size >= flush:
                        model.run(held, vocab.end, lanes, window, rate)
                        seen, held, size = seen + size, [], 0
            if held:
                model.run(held, vocab.end, lanes, window, rate)
                seen += size
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([_pack(model.p) + _pack(model.grad2)], pa.binary()), pa.array([seen], pa.int64())], names=["state", "seen"])

        return rows

    def average(batches):
        total, seen = None, 0
        for b in batches:
            for raw, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                v = np.frombuffer(raw, "<f4").astype(np.float64) * n
                total, seen = v if total is None else total + v, seen + n
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([(total / seen).astype("<f4").tobytes()], pa.binary()), pa.array([seen], pa.int64())], names=["state", "seen"])

    back = F.pmod(F.xxhash64("text"), F.lit(kept)) == 0
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds))
    for r in range(rounds):
        own = docs.filter(~back & (part == r)).select("text")
        parts = own.mapInArrow(learn(weights, slopes), schema).repartition(merge).mapInArrow(average, schema).collect()  # ``merge`` rows
        if parts:
            seen = sum(p["seen"] for p in parts)
            mean = sum(np.frombuffer(p["state"], "<f4").astype(np.float64) * (p["seen"] / seen) for p in parts).astype("<f4").tobytes()
            weights, slopes = _unpack(mean[: len(mean) // 2], weights), _unpack(mean[len(mean) // 2 :], weights)
            tried.append(weights)

    unigram = np.log(np.maximum(vocab.mass, 1) / np.maximum(vocab.mass, 1).sum())

    def judge(batches):
        models, total = [Gru(p, vocab.bounds) for p in tried[1:]], np.zeros(len(tried))

        def score(held):
            total[0] += sum(unigram[x].sum() + unigram[vocab.end] for x in held)
            total[1:] += [m.run(held, vocab.end, 4 * lanes, window).sum() for m in models]

        held, size = [], 0
        for b in batches:
            for w in words(b.column(0), lower=True):
                held += np.split(vocab.ids(w.hash), w.cut[1:-1])
                size += len(w.hash) + w.n
                if size >= flush:
                    score(held)
                    held, size = [], 0
        if held:
            score(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(tried))), pa.array(total)], names=["k", "score"])

    scores = docs.filter(back).select("text").mapInArrow(judge, "k long, score double").groupBy("k").agg(F.sum("score").alias("score")).collect()  # a row for each of the weights
    return tried[max(scores, key=lambda r: (r["score"], -r["k"]))["k"]] if scores else weights


def score_documents(spark: SparkSession, docs: DataFrame, fold: int = 0, folds: int = 10, vocabulary: int | None = None, classes: int | None = None, coverage: float = 0.6, hidden: int = 16, head: int = 1 << 18, lanes: int = 64, window: int = 32, rate: float = 0.2, rounds: int = 2, flush: int = 2_000_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row for each input row.

    Documents of the fold are not learnt from; a null doc_id is in no fold. Null and empty texts are the end alone.
    A long text is read whole, in one lane, and takes room in proportion to its tokens. Rows that are equal are scored each, columns but doc_id and text play no part.
    An empty table gives no rows; with no training documents every token is unknown and scores are those of the smoothed unigram alone.
    """
    tune(spark, 1024)
    scratch = Scratch(spark, "lm")
    docs = need(docs, "doc_id", "text").withColumn("held_out", held_out(fold, folds))
    counts = scratch.write(token_counts(docs.filter("not held_out")))
    total, distinct = (x or 0 for x in counts.agg(F.sum("c"), F.count(F.lit(1))).first())
    top = most_frequent(counts, head)
    c = top["c"].to_numpy(np.int64)
    vocabulary = vocabulary or size_for(c, int(total), coverage)
    classes = classes or round(vocabulary**0.5)
    vocab = Vocabulary(top["h"].to_numpy(np.int64).view(np.uint64), c, int(total), int(distinct), vocabulary, classes)
    weights = train(docs.filter("not held_out"), vocab, hidden, lanes, window, rate, flush, rounds)
    bounds = vocab.bounds

    def score(batches):
        model = Gru(weights, bounds)
        held: list = []
        size = 0

        def done():
            logs = model.run([x[0] for x in held], vocab.end, 4 * lanes, window) / np.log(10)
            for at in range(0, len(held), 1000):
                part = held[at : at + 1000]
                tails = [x[3] for x in part]
                cuts = pa.array(np.concatenate(([0], np.cumsum([len(t) for t in tails]))), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[1] for x in part], pa.int64()), *(pa.array([x[2][k] for x in part], pa.int64()) for k in (0, 1)), pa.array([x[2][2] for x in part], pa.float64()), pa.array([x[2][3] for x in part] + logs[at : at + 1000], pa.float64()), pa.ListArray.from_arrays(cuts, pa.array(np.concatenate(tails).view(np.int64)))],
                    names=["doc_id", "n_tokens", "n_known", "base", "score", "tail"],
                )

        end_count = vocab.count(np.array([END], np.uint64))[0]
        share = np.log10(max(vocab.rest, 1e-300))
        for b in batches:
            ids = b.column(0).to_pylist()
            for w in words(b.column(1), lower=True):
                number, c = vocab.ids(w.hash), vocab.count(w.hash)
                logs = np.where(c > 0, vocab.unigram(c), 0)
                other = number == vocab.other
                sums = [np.concatenate(([0], np.cumsum(v)))[w.cut] for v in (c > 0, logs, np.where(other, logs, 0), other)]
                for d in range(w.n):
                    a, e = w.cut[d], w.cut[d + 1]
                    known, base, far, n_other = (float(v[d + 1] - v[d]) for v in sums)
                    own = w.hash[a:e]
                    held.append((number[a:e], ids[w.first + d], (int(e - a) + 1, int(known) + int(end_count > 0), base + float(vocab.unigram(end_count)), far - n_other * share), own[c[a:e] == 0]))
                size += len(w.hash) + w.n
                if size >= flush:
                    yield from done()
                    held.clear()
                    size = 0
        if held:
            yield from done()

    local = docs.select("doc_id", "text").mapInArrow(score, "doc_id long, n_tokens long, n_known long, base double, score double, tail array<long>")
    local = scratch.write(local.withColumn("rid", F.monotonically_increasing_id()))
    scale = float(total) + 0.1 * (float(distinct) + 1)
    rare = local.select("rid", F.explode("tail").alias("h")).groupBy("h", "rid").count().join(counts, "h", "left")
    log = F.log10((F.coalesce("c", F.lit(0)) + 0.1) / scale)
    rare = rare.groupBy("rid").agg(F.sum(F.col("count") * log).alias("log"), F.sum(F.when(F.col("c") > 0, F.col("count")).otherwise(0)).alias("known"))
    out = local.drop("tail").join(rare, "rid", "left")
    more = F.coalesce("log", F.lit(0.0))
    return out.select("doc_id", held_out(fold, folds).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("score") + more).alias("score"))

"""Operator 9, toxicity: cumulative-link ordinal regression on sparse text features.

P(grade > k) = sigmoid(w . x - threshold_k): the weights are shared across the ordered thresholds, and
the sum over k is the expected severity. Features are words and their first four and five bytes, hashed;
x is 1 + log of how often a feature occurs.

Labels are 0 or 1. Grade 0 is not toxic; toxic documents are of grade 1, or of grade 2 if they have more
occurrences of telling features than the median toxic document of the sample. The classifier is fitted on at most ``sample``
labelled rows (by a hash of doc_id), a fixed bound, whose ids are small enough to broadcast. Scoring
is a narrow map over whole texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, mix, need, tune
from .words import Words, words


def features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all words and the document of each."""
    n, doc = w.end - w.start, w.doc
    keys, docs = [w.hash], [doc]
    code = np.zeros(len(n), np.uint64)
    for j in range(5):
        code |= w.data[np.minimum(w.start + j, len(w.data) - 1)].astype(np.uint64) << np.uint64(8 * j)
        if j >= 3:
            own = n > j
            keys.append(mix(code[own] ^ np.uint64((j + 1) << 56)))
            docs.append(doc[own])
    return np.concatenate(keys), np.concatenate(docs)


def ordinal_fit(x: np.ndarray, y: np.ndarray, grades: int, l2: float = 1e-5, steps: int = 400, rate: float = 0.2) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds of the cumulative-link model, by Adam on the mean negative log-likelihood over all thresholds."""
    w = np.zeros(x.shape[1])
    share = np.array([(y > k).mean() for k in range(grades - 1)]).clip(1e-4, 1 - 1e-4)
    t = np.log((1 - share) / share)
    m, v = np.zeros(len(w) + len(t)), np.zeros(len(w) + len(t))
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip((x @ w)[:, None] - t, -40, 40)))
        err = (p - (y[:, None] > np.arange(grades - 1))) / len(y)
        g = np.concatenate([x.T @ err.sum(axis=1) + l2 * w, -err.sum(axis=0)])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        d = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8) * (0.1 + 0.9 * (1 - step / steps))
        w -= d[: len(w)]
        t = np.maximum.accumulate(t - d[len(w) :])
    return w, t


def grader(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = 12_000, keep: int = 512, grades: int = 3, least: int = 3):
    """A function from an Arrow text column to (expected grade, whether toxic); None without any toxic label or telling feature."""
    tune(spark, 1024)
    docs = need(docs, "doc_id", "text")
    picked = need(labels, "doc_id", "toxic").filter("doc_id is not null and toxic is not null").dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    own = Scratch(spark, "toxicity").write(docs.join(F.broadcast(picked), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic")))  # at most ``sample`` labels are broadcast

    def seen(batches):
        for b in batches:
            y = b.column(1).to_numpy().astype(np.int64)
            keys, tox = [], []
            for w in words(b.column(0), lower=True, stops=True):
                k, d = features(w)
                pair = np.unique(np.rec.fromarrays([k, d]))
                keys.append(pair["f0"])
                tox.append(y[w.first + pair["f1"]])
            if keys:
                k, t = np.concatenate(keys), np.concatenate(tox)
                u, back = np.unique(k, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(np.bincount(back, t).astype(np.int64)), pa.array(np.bincount(back).astype(np.int64))], names=["f", "tox", "n"])

    n_tox, n_all = (int(v or 0) for v in own.agg(F.sum("toxic"), F.count(F.lit(1))).first())
    if not n_tox or n_tox == n_all:
        return None
    tallies = own.mapInArrow(seen, "f long, tox long, n long").groupBy("f").agg(F.sum("tox").alias("tox"), F.sum("n").alias("n"))
    a, b = F.col("tox") + 0.5, F.col("n") - F.col("tox") + 0.5
    odds = F.log(a / (n_tox + 1)) - F.log(b / (n_all - n_tox + 1))
    chi = (a - F.col("n") * (n_tox / n_all)) ** 2 / (F.col("n") * (n_tox / n_all) + 1)
    best = tallies.filter((F.col("tox") >= least) & (odds > 1) & (chi > 12)).orderBy(chi.desc(), "f").limit(keep).select("f").collect()  # at most ``keep`` rows
    if not best:
        return None
    keys = np.sort(np.array([r["f"] for r in best], np.int64).view(np.uint64))

    def found(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, feature number, count) of the features that matter."""
        k, d = features(w)
        at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
        hit = keys[at] == k
        u, n = np.unique(d[hit] * len(keys) + at[hit], return_counts=True)
        return u // len(keys), u % len(keys), n

    def sparse(batches):
        for b in batches:
            out = [b""] * len(b.column(0))
            for w in words(b.column(0), lower=True, stops=True):
                d, f, n = found(w)
                cut = np.searchsorted(d, np.arange(w.n + 1))
                for j in np.flatnonzero(np.diff(cut)):
                    s = slice(cut[j], cut[j + 1])
                    out[w.first + j] = np.column_stack([f[s], n[s]]).astype(np.int32).tobytes()
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(out, pa.binary())], names=["toxic", "x"])

    rows = own.mapInArrow(sparse, "toxic int, x binary").collect()  # at most ``sample`` rows
    x = np.zeros((len(rows), len(keys)), np.float32)
    heavy = np.zeros(len(rows))
    for i, r in enumerate(rows):
        pair = np.frombuffer(r["x"], np.int32).reshape(-1, 2)
        x[i, pair[:, 0]] = 1 + np.log(pair[:, 1])
        heavy[i] = pair[:, 1].sum()
    y = np.array([r["toxic"] for r in rows])
    grade = y + (y * (heavy > np.median(heavy[y == 1])) if grades > 2 else 0)
    weights, thresholds = ordinal_fit(x, grade, grades)

    def grade_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        z = np.zeros(len(col))
        for w in words(col, lower=True, stops=True):
            d, f, n = found(w)
            z[w.first : w.first + w.n] = np.bincount(d, weights[f] * (1 + np.log(n)), w.n)
        p = 1 / (1 + np.exp(-np.clip(z[:, None] - thresholds, -40, 40)))
        empty = col.is_null().to_numpy(zero_copy_only=False)
        return np.where(empty, 0, p.sum(axis=1)), (p[:, 0] >= 0.5) & ~empty

    return grade_of


def severity(spark: SparkSession, docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """doc_id, severity (expected grade, 0 to grades - 1), toxic (more likely than not of grade 1 or above): one row for each input row.

    Null texts have severity 0 and are not toxic, as are all without any toxic label to learn from. Labels that are null,
    or whose document is not there, teach nothing; of several labels of a document one counts.
    """
    grade_of = grader(spark, docs, labels, **how)
    docs = need(docs, "doc_id", "text")
    if grade_of is None:
        return docs.select("doc_id", F.lit(0.0).alias("severity"), F.lit(False).alias("toxic"))

    def score(batches):
        for b in batches:
            grade, toxic = grade_of(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(grade), pa.array(toxic)], names=["doc_id", "severity", "toxic"])

    return docs.mapInArrow(score, "doc_id long, severity double, toxic boolean")


def not_toxic(spark: SparkSession, docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The documents that are not toxic, with all their columns."""
    grade_of = grader(spark, docs, labels, **how)
    if grade_of is None:
        return docs
    at = docs.columns.index("text")

    def keep(batches):
        for b in batches:
            yield b.filter(pa.array(~grade_of(b.column(at))[1]))

    return docs.mapInArrow(keep, docs.schema)

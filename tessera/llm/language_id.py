"""Operator 4, language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Letters are lower-cased, all else separates words; n-grams of one to three characters that do not
reach across a separator are hashed to a fixed table. The weights are fitted with the
follow-the-regularised-leader rule under elastic-net penalties, then one temperature calibrates the scores.

Document frequencies cover all training texts. The classifier is fitted on at most ``sample`` of them (by a hash of
doc_id), a fixed bound. Prediction is a narrow map over whole texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import need, tune

SIZE = 1 << 16
TABLE = 0x3000  # code points with a row of their own; those beyond count as letters of their low bits
_table: list[np.ndarray] = []


def letters() -> np.ndarray:
    """By code point: a small number for each letter, lower-cased; 0 for all else."""
    if not _table:
        t = np.zeros(TABLE + 1, np.uint32)
        for c in range(TABLE):
            if chr(c).isalpha():
                low = chr(c).lower()
                t[c] = ord(low[0])
        t[TABLE] = TABLE
        _table.append(t)
    return _table[0]


def ngrams(texts: list[str]):
    """Hashed features of all texts together, the text of each, and whether a text has a letter."""
    raw = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in texts])
    code = letters()[np.minimum(raw, TABLE)]
    far = np.flatnonzero(raw >= TABLE)
    if len(far):
        alpha = {c: chr(c).isalpha() for c in np.unique(raw[far]).tolist()}
        code = code.copy()
        code[far] = [TABLE + (c & 0xFFF) if alpha[c] else 0 for c in raw[far].tolist()]
    doc_end = np.zeros(len(raw), bool)
    doc_end[ends - 1] = True
    keep = (code > 0) | np.concatenate(([True], code[:-1] > 0)) | doc_end  # one separator between words
    code = code[keep].astype(np.uint32)
    cut = np.concatenate(([0], np.cumsum(keep)[ends - 1]))
    b = np.concatenate([code[1:], [np.uint32(0)]])
    c = np.concatenate([code[2:], np.zeros(min(2, len(code)), np.uint32)])
    with np.errstate(over="ignore"):
        h1 = code * np.uint32(0x9E3779B1)
        h2 = (h1 ^ (h1 >> np.uint32(15))) + b * np.uint32(0x85EBCA77)
        h3 = (h2 ^ (h2 >> np.uint32(13))) * np.uint32(0xC2B2AE3D) + c * np.uint32(0x27D4EB2F)
        one, two, three = ((h * np.uint32(0x165667B1)) >> np.uint32(16) for h in (h1 + np.uint32(1), h2 * np.uint32(5) + np.uint32(2), h3 + np.uint32(3)))
    # feature SIZE has no weight
    none = np.uint32(SIZE)
    one = np.where(code > 0, one, none)
    two = np.where((code > 0) | (b > 0), two, none)
    two[cut[1:] - 1] = none  # no n-gram begins at a text's last place, which is a separator
    three = np.where((b > 0) & ((code > 0) | (c > 0)), three, none)
    three[cut[1:] - 1] = none
    has = np.add.reduceat(code > 0, cut[:-1]) > 0
    return (one, two, three), cut, has


def document_frequency(docs: DataFrame) -> np.ndarray:
    def count(batches):
        total = np.zeros(SIZE + 1, np.int64)
        mark = np.zeros(SIZE + 1, np.int64)
        for b in batches:
            texts = b.column(0).to_pylist()
            grams, cut, _ = ngrams(texts)
            for d in range(len(texts)):
                for g in grams:
                    mark[g[cut[d] : cut[d + 1]]] = 1
                total += mark
                mark[:] = 0
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k])], names=["f", "n"])

    out = np.zeros(SIZE + 1, np.int64)
    for r in docs.select("text").mapInArrow(count, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).collect():  # at most SIZE + 1 rows
        out[r["f"]] = r["n"]
    return out


class Ftrl:
    """Follow the regularised leader with per-coordinate rates; L1 sets weights to zero, L2 shrinks the others."""

    def __init__(self, features: int, labels: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.002, l2: float = 0.01):
        self.z, self.n = np.zeros((features, labels)), np.zeros((features, labels))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, k=slice(None)) -> np.ndarray:
        z, n = self.z[k], self.n[k]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, k: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(k)
        p = x @ w
        p = np.exp(p - p.max())
        p /= p.sum()
        p[y] -= 1
        g = x[:, None] * p
        n = self.n[k]
        self.z[k] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[k] = n + g * g


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], labels: int, epochs: int, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights (features, labels) and the temperature. rows: feature numbers, values and label; a fifth is kept back for the temperature."""
    rng = np.random.default_rng(seed)
    model = Ftrl(SIZE + 1, labels)
    held, own = rows[::5], [r for k, r in enumerate(rows) if k % 5] or rows
    for _ in range(epochs):
        for k in rng.permutation(len(own)):
            model.learn(*own[k])
    w = model.weights()
    logits = np.array([x @ w[k] for k, x, _ in held])
    y = np.array([r[2] for r in held])

    def loss(t: float) -> float:
        z = logits / t
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(y)), y]).mean())

    return w, min(np.geomspace(0.05, 20, 121), key=loss)


def identify(spark: SparkSession, docs: DataFrame, fold: int = 2, folds: int = 4, sample: int = 3000, least: int = 100, epochs: int = 3, scale: float = 30.0) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row for each input row.

    The classifier is fitted on ``sample`` documents: ``least`` of each language first, where there are so many, and others by a hash of their ids.
    Documents of the fold teach nothing, nor do those with a null text, lang or doc_id. A text that is null or has no letter is
    ``und`` with score 0, as is every text if there is nothing to learn from.
    """
    tune(spark, 512)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold, F.lit(False)).alias("held_out")
    known = need(docs, "doc_id", "text", "lang").filter("text is not null and lang is not null and doc_id is not null").filter(~held_out)
    df = document_frequency(known)
    n_docs = known.count()
    idf = np.log((1 + n_docs) / (1 + df)) + 1
    idf[SIZE] = 0

    def counted(batches):
        for b in batches:
            texts = b.column(0).to_pylist()
            grams, cut, has = ngrams(texts)
            keys, values = [], []
            for d in range(len(texts)):
                k, n = np.unique(np.concatenate([g[cut[d] : cut[d + 1]] for g in grams]), return_counts=True)
                v = n * idf[k]
                keys.append(k.astype(np.int32).tobytes())
                values.append((v / max(v.sum(), 1e-9)).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(values, pa.binary()), b.column(1), pa.array(has)], names=["k", "v", "lang", "has"])

    own = known.select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    own = own.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).filter(F.col("r") <= sample)  # Spark trims each task's rows first
    ids = own.orderBy(F.col("r") > least, "h", "doc_id").limit(sample).select("doc_id")
    picked = known.join(F.broadcast(ids), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("text", "lang")  # at most ``sample`` ids are broadcast
    rows = picked.mapInArrow(counted, "k binary, v binary, lang string, has boolean").filter("has").collect()  # at most ``sample`` rows
    names = sorted({r["lang"] for r in rows})
    if rows:
        rows_ = [(np.frombuffer(r["k"], np.int32), np.frombuffer(r["v"], np.float32).astype(float) * scale, names.index(r["lang"])) for r in rows]
        w, temperature = fit(rows_, len(names), epochs)
        folded = np.concatenate([w * (idf[:, None] * scale), idf[:, None]], axis=1).astype(np.float32)

    def predict(batches):
        for b in batches:
            for at in range(0, len(b.column(0)), 64):
                part = b.slice(at, 64)
                texts = [t or "" for t in part.column(1).to_pylist()]
                grams, cut, has = ngrams(texts)
                if rows:
                    total = sum(np.add.reduceat(np.take(folded, g, axis=0), cut[:-1], axis=0) for g in grams).astype(float)
                    z = total[:, :-1] / np.maximum(total[:, -1:], 1e-9) / temperature
                    p = np.exp(z - z.max(axis=1, keepdims=True))
                    p /= p.sum(axis=1, keepdims=True)
                    best = p.argmax(axis=1)
                    lang = [names[k] if h else "und" for k, h in zip(best, has, strict=True)]
                    score = np.where(has, p.max(axis=1), 0.0)
                else:
                    lang, score = ["und"] * len(texts), np.zeros(len(texts))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    out = need(docs, "doc_id", "text").mapInArrow(predict, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out, "lang_pred", "score")

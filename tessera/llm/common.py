"""Shared helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these six ASCII white-space bytes; bytes.split() cuts at the same six.
SPACES = rb"[\x20\x09-\x0D]"


def tune(spark: SparkSession, rows: int = 1024) -> None:
    """Bound the Arrow batches that Python workers hold: long texts make row counts a poor bound."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it; a local one only where none is named and the master is local (tests)."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = getattr(spark.sparkContext, "_tessera_dir", None) or tempfile.mkdtemp(prefix="tessera_")
        spark.sparkContext._tessera_dir = named
    return named.rstrip("/")


class Scratch:
    """Tables written to the shared folder to cut lineage; they survive the loss of executors.

    ``drop`` frees a table that nothing reads any more. What is still read lazily by a returned
    DataFrame stays.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0

    def write(self, df: DataFrame, partition_hint: int | None = None) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        out = df.coalesce(partition_hint) if partition_hint else df
        out.write.option("compression", "zstd").parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._tessera_path = path
        return back

    def drop(self, df: DataFrame) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(df._tessera_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def free_shuffles(self) -> None:
        """Let Spark's cleaner remove shuffle files of plans that are no longer referenced."""
        import gc

        gc.collect()
        self.spark._jvm.System.gc()


class Bloom:
    """A bit table of 64-bit ids that goes with the tasks: an id that is not ``among`` them is certainly none of them.

    It has about 12 bits an id, 2**27 bits (16 MB) at most, and is put together by words of 64 bits. It only spares the shuffle of rows that are not
    wanted; an exact join follows. Beyond some 13 million ids more and more rows pass it, until they all are shuffled.
    """

    PROBES, MOST = 4, 1 << 27

    def __init__(self, ids: DataFrame):
        """ids: a DataFrame whose first column is of 64-bit numbers."""
        ids = ids.select(F.col(ids.columns[0]).cast("long").alias("id"))
        n = ids.count()
        self.bits = bits = max(1 << 12, min(self.MOST, 1 << (12 * n).bit_length()))
        places = self.places

        def mark(batches):
            table = np.zeros(bits // 64, np.uint64)
            for b in batches:
                at = places(b.column(0).to_numpy()).ravel()
                np.bitwise_or.at(table, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
            k = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(table[k].view(np.int64))], names=["k", "w"])

        self.table = np.zeros(bits // 64, np.uint64)
        got = ids.mapInArrow(mark, "k long, w long").groupBy("k").agg(F.bit_or("w").alias("w")).toArrow()  # bits / 64 rows at most
        self.table[got["k"].to_numpy()] = got["w"].to_numpy().view(np.uint64)

    def places(self, ids: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            a = mix(ids.view(np.uint64))
            step = mix(a ^ np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
            return (a[:, None] + step[:, None] * np.arange(self.PROBES, dtype=np.uint64)) & np.uint64(self.bits - 1)

    def among(self, ids: np.ndarray) -> np.ndarray:
        at = self.places(np.ascontiguousarray(ids, np.int64))
        return ((self.table[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=1)

    def wanted(self, df: DataFrame) -> DataFrame:
        """The rows of df whose first column may be among the ids."""

        def some(batches, among=self.among):
            for b in batches:
                yield b.filter(pa.array(among(b.column(0).to_numpy())))

        return df.mapInArrow(some, df.schema)


#: Stands for a null doc_id where ids order last.
LAST = 2**63 - 1


def row_key() -> list[F.Column]:
    """What tells a row of documents from others: its doc_id (LAST for null) and a hash of its text."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), F.xxhash64(F.coalesce(F.col("text"), F.lit("")))]


def staying(scratch: Scratch, docs: DataFrame, verdict: DataFrame) -> DataFrame:
    """docs, with all their columns, without the rows that do not stay. verdict: doc_id, text_key (as row_key has them) and ``stays`` for
    each row of docs. Of rows that stay and are equal in doc_id and text, one does."""
    per = verdict.groupBy("doc_id", "text_key").agg(F.bool_or("stays").alias("stays"), F.count(F.lit(1)).alias("n")).filter("not stays or n > 1")
    per = scratch.write(per.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), "stays"))
    ident, key = row_key()
    on = ["__id", "__key"]
    told = docs.withColumn("__id", ident).withColumn("__key", key)
    out = told.join(per.select(*on), on, "left_anti")
    many = per.filter("stays")
    if many.limit(1).count():
        out = out.unionByName(told.join(many.select(*on), on, "left_semi").dropDuplicates(on))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def need(df: DataFrame, *cols: str) -> DataFrame:
    """Only the named columns: extra columns of the input, whatever their names, play no part."""
    return df.select(*[F.col(f"`{c}`") for c in cols])


def as_bytes(col: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes; null counts as empty."""
    return [x or b"" for x in col.cast(pa.binary()).to_pylist()]


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a batch as one byte buffer and the offsets of each, without copying; null is empty."""
    col = pa.compute.fill_null(col.cast(pa.binary()), b"")
    offsets = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None and offsets[-1] > 0 else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser (splitmix64): makes polynomial hashes comparable as random numbers."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


BASE = 0x9E3779B97F4A7C15  # odd


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """Rabin-Karp hashes, modulo 2**64, of all windows of n symbols: sum of h[i+j] * BASE**(n-1-j).

    Windows of doubling widths are combined, so that the cost is log n passes.
    """
    if len(h) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out, have, part, width = None, 0, h, 1
        while True:
            if n & width:
                if out is None:
                    out, have = part, width
                else:  # the wider part stands first
                    m = len(h) - have - width + 1
                    out, have = part[:m] * np.uint64(pow(BASE, have, 1 << 64)) + out[width : width + m], have + width
            if have == n:
                return out
            m = len(part) - width
            part = part[:m] * np.uint64(pow(BASE, width, 1 << 64)) + part[width : width + m]
            width *= 2


def sliding_min(a: np.ndarray, n: int) -> np.ndarray:
    """Minimum of all windows of n elements, by windows of doubling widths."""
    width = 1
    while width * 2 <= n:
        a = np.minimum(a[:-width], a[width:])
        width *= 2
    return np.minimum(a[: len(a) - (n - width)], a[n - width :]) if width < n else a


def runs_of(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    start = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
    return start, np.diff(np.append(start, len(a)))

"""Drifted files of the table ``clients`` and what the query of operator 11 tells of them before and after the rewrite.

Rows get their place in the whole order without any step in one task: a range shuffle, numbers within each partition, and sums of the
partitions' sizes. At most 1,000 files are made, whatever the size of the table.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, need
from .schema_rewrite import ID, fingerprint, footers, rewrite, with_ids

COLUMNS = "client_id master_id source updated_at name email city nation_id segment balance".split()
DEFAULTS = {"nation_id": -1, "city": "none"}


def version_of(file_no: int) -> int:
    v = zlib.crc32(f"7:{file_no}".encode()) % 24
    return v if v < 16 else 0


def evolved_of(clients: DataFrame) -> T.StructType:
    own = T.StructType([T.StructField(c, T.LongType() if c == "nation_id" else clients.schema[c].dataType) for c in COLUMNS])
    return with_ids(own)


def drifted(version: int, evolved: T.StructType) -> list[tuple[str, T.StructField]]:
    """The columns of a starting file: for each the evolved column that it holds, and its own name, type and id."""
    out = []
    for f in evolved:
        name = {"name": "email", "email": "name"}.get(f.name, f.name) if version & 1 else f.name
        kind = {"balance": T.FloatType(), "nation_id": T.IntegerType()}.get(f.name, f.dataType) if version & 8 else f.dataType
        if not (version & 4 and f.name in DEFAULTS):
            out.append((f.name, T.StructField(name, kind, True, f.metadata)))
    return out[:1] + out[:0:-1] if version & 2 else out


def ranked(scratch: Scratch, clients: DataFrame) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """The rows with r, their number in the order of crc32 and client_id, and the file they go to: file_no, version and part, its number among those of its version; and
    these three for all files.

    A null client_id comes first. Rows that share a client_id follow the hash of all their columns; a random number splits even a
    third of all rows that are equal in every column, which may stand in any order.
    """
    spark = clients.sparkSession
    keys = ["__crc", "client_id", "__tie", "__salt"]
    keyed = clients.withColumn("__crc", F.crc32(F.col("client_id").cast("string"))).withColumn("__tie", F.xxhash64(*COLUMNS)).withColumn("__salt", F.rand(7))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = keyed.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select(*COLUMNS, F.monotonically_increasing_id().alias("__place"))
    rows = scratch.write(rows).withColumn("__part", F.shiftright("__place", 33))
    sizes = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))  # a row a partition
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("__part", before.alias("__before"))
    n = rows.count()
    per = 1 + n // 1000
    rows = rows.join(sizes, "__part").withColumn("r", F.col("__before") + F.col("__place").bitwiseAND(F.lit((1 << 33) - 1)))
    rows = rows.withColumn("file_no", F.floor(F.col("r") / per).cast("int"))
    files, count = [], [0] * 16
    for f in range(-(-n // per)):  # 1,000 at most
        v = version_of(f)
        files.append((f, v, count[v]))
        count[v] += 1
    rows = rows.join(spark.createDataFrame(files, "file_no int, version int, part int"), "file_no").select(*COLUMNS, "r", "file_no", "part", "version")
    path = f"{scratch.root}/ranked"
    rows.write.partitionBy("version").parquet(path)
    return spark.read.schema(rows.schema).parquet(path), files


def start_files(rows: DataFrame, files: list[tuple[int, int, int]], evolved: T.StructType, folder: str) -> DataFrame:
    """Write the starting files, a job a version; schema, part, file_no, version: what tells which file is which."""
    known = []
    for version in range(16):
        own = [(f, part) for f, v, part in files if v == version]
        if not own:
            continue
        columns = drifted(version, evolved)
        part = rows.filter(F.col("version") == version).repartitionById(len(own), "part").sortWithinPartitions("part", "r")
        part.select(*[F.col(held).cast(f.dataType).alias(f.name, metadata=f.metadata) for held, f in columns]).write.mode("append").parquet(folder)
        schema = fingerprint(T.StructType([f for _, f in columns]))
        known += [(schema, part, f, version) for f, part in own]
    return rows.sparkSession.createDataFrame(known, "schema string, part int, file_no int, version int")


def micros(c: str, kind: T.DataType) -> Column:
    """Microseconds since 1970 in UTC; a time without a zone is one of UTC, whatever the session's zone."""
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)
    seconds = F.unix_date(F.col(c).cast("date")).cast("long") * 86400 + F.hour(c) * 3600 + F.minute(c) * 60
    return seconds * 1000000 + (F.extract(F.lit("SECOND"), F.col(c)) * 1000000).cast("long")


def digests(rows: DataFrame, files: int, evolved: T.StructType) -> DataFrame:
    """file_no, n_rows, n_nulls, ids_sha256, rows_sha256: each file's rows pass through one task, in order, as they must for one sha256. rows: file_no, __row and the evolved columns."""
    text = {f.name: F.col(f.name).cast("string") for f in evolved}
    text["updated_at"] = micros("updated_at", evolved["updated_at"].dataType).cast("string")
    text["balance"] = F.floor(F.col("balance") * 1048576).cast("string")
    nulls = sum((F.col(c).isNull().cast("int") for c in COLUMNS), F.lit(0))
    line = F.concat_ws("|", *[F.coalesce(text[c], F.lit("?")) for c in COLUMNS])
    parts = min(files, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    lines = rows.select(F.col("file_no").cast("int").alias("file_no"), "__row", nulls.alias("nulls"), F.coalesce(text["client_id"], F.lit("?")).alias("id"), line.alias("line"))
    lines = lines.repartitionById(parts, "file_no").sortWithinPartitions("file_no", "__row").select(F.col("file_no").cast("long"), "nulls", "id", "line")

    def digest(batches):
        import numpy as np

        now, n, none, ids, whole, out = None, 0, 0, None, None, []
        close = lambda: (now, n, none, ids.hexdigest(), whole.hexdigest())
        for b in batches:
            file_no, nulls = b.column(0).to_numpy(), b.column(1).to_numpy()
            cut = [0, *(np.flatnonzero(np.diff(file_no)) + 1).tolist(), len(file_no)]
            for a, z in zip(cut, cut[1:], strict=False):
                if a == z:
                    continue
                if file_no[a] != now:
                    if now is not None:
                        out.append(close())
                    now, n, none, ids, whole = int(file_no[a]), 0, 0, hashlib.sha256(), hashlib.sha256()
                for into, sep, col in ((ids, ",", 2), (whole, "\n", 3)):
                    into.update(((sep if n else "") + sep.join(b.column(col).slice(a, z - a).to_pylist())).encode())
                n, none = n + z - a, none + int(nulls[a:z].sum())
        if now is not None:
            out.append(close())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["file_no", "n_rows", "n_nulls", "ids_sha256", "rows_sha256"])

    return lines.mapInArrow(digest, "file_no long, n_rows long, n_nulls long, ids_sha256 string, rows_sha256 string")


def drifted_clients(spark: SparkSession, clients: DataFrame) -> DataFrame:
    """One row for each final file: file_no, version, n_rows, n_nulls, ids_sha256, rows_sha256, start_columns, columns, rewritten, path.

    A null client_id stands first and is ``?`` in both digests. A balance that is no number counts as 0, an infinite one as the largest long of its sign. Columns beside the ten of ``clients`` play no part. An empty table gives
    no file and no row. Every call has a folder of its own below the shared one and leaves it there. path: without
    a scheme where local files are the session's default, else a URI.
    """
    clients = need(clients, *COLUMNS)
    evolved = evolved_of(clients)
    scratch = Scratch(spark, "drifted")
    rows, files = ranked(scratch, clients)
    shape = "file_no long, version int, n_rows long, n_nulls long, ids_sha256 string, rows_sha256 string, start_columns string, columns string, rewritten boolean, path string"
    if not files:
        return spark.createDataFrame([], shape.replace("version int", "version long"))
    folder = f"{scratch.root}/files"
    known = start_files(rows, files, evolved, folder)
    part = F.regexp_extract("path", r"/part-(\d+)-[^/]*$", 1).cast("int")
    start = footers(spark, folder).withColumn("part", part).join(known, ["schema", "part"])
    start = scratch.write(start.select("path", F.col("file_no").cast("long").alias("file_no"), F.col("version").cast("long").alias("version"), F.col("columns").alias("start_columns"), (F.col("schema") != fingerprint(evolved)).alias("rewritten")), 1)
    rewrite(spark, folder, evolved, DEFAULTS)
    final = spark.read.schema(evolved).parquet(folder)
    meta = final.metadataColumn("_metadata")
    final = final.select("*", meta["file_path"].alias("path"), meta["row_index"].alias("__row")).join(start.select("path", "file_no"), "path")
    told = start.join(footers(spark, folder).select("path", "columns"), "path")
    out = told.join(digests(final, len(files), evolved), "file_no")
    if (spark._jsc.hadoopConfiguration().get("fs.defaultFS") or "").startswith("file:"):
        out = out.withColumn("path", F.regexp_replace("path", "^file:/+", "/"))
    return out.select("file_no", "version", "n_rows", "n_nulls", "ids_sha256", "rows_sha256", "start_columns", "columns", "rewritten", "path")


__all__ = ["COLUMNS", "DEFAULTS", "ID", "drifted", "drifted_clients", "evolved_of", "version_of"]

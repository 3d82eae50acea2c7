"""Operator 11, rewrite of Parquet files whose schemas have drifted: schema-fingerprint grouping.

Tasks read the footers of a folder's files. Files are grouped by their schema, columns told by Parquet field id; each distinct
schema becomes one scan with one native projection to the evolved schema. The union of these plans is shuffled by file and sorted by row index, so that each file is
written again by one task, rows and order kept, while memory stays that of a sort which spills. Files that have the evolved schema are not touched.

A rewritten file takes the place of the old one under its name. New files are staged in a hidden folder, whose list of moves
is written last; moves are done by tasks and can be repeated. A rewrite that was interrupted is finished by the next one, or, where its list is missing, is
thrown away: at any moment each file is whole, old or new.

Scale: rows are shuffled once. The driver sees the distinct schemas and the names of the files that change, as Spark's own listing does; no rows.
"""

from __future__ import annotations

import json
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ID = "parquet.field.id"
#: More distinct schemas than this are taken for an error: each is a plan of its own.
MOST_SCHEMAS = 1024
STAGE = "_rewrite-"


def with_ids(schema: T.StructType, first: int = 1) -> T.StructType:
    """The schema with all columns nullable and field ids counted from ``first``."""
    return T.StructType([T.StructField(f.name, f.dataType, True, {ID: first + i}) for i, f in enumerate(schema)])


def fingerprint(schema: T.StructType) -> str:
    """What tells schemas apart: id, name, type and nullability of each column, in order."""
    return json.dumps([[f.metadata.get(ID), f.name, f.dataType.simpleString(), f.nullable] for f in schema])


def files_of(spark: SparkSession, folder: str) -> DataFrame:
    """path: the data files of a folder; hidden ones and those below hidden folders are none. Contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folder)
    return found.select(found.metadataColumn("_metadata")["file_path"].alias("path"))


def footers(spark: SparkSession, folder: str) -> DataFrame:
    """path, n_rows, schema (its fingerprint), columns (the names, comma-joined): of each data file, read from its footer in a task."""

    def read(batches):
        import pyarrow.parquet as pq
        from pyarrow import fs
        from pyspark.sql.pandas.types import from_arrow_type

        for b in batches:
            rows = []
            for uri in b.column(0).to_pylist():
                store, path = fs.FileSystem.from_uri(uri)
                with store.open_input_file(path) as f:
                    meta = pq.ParquetFile(f)
                    own = []
                    for x in meta.schema_arrow:
                        given = (x.metadata or {}).get(b"PARQUET:field_id")
                        own.append(T.StructField(x.name, from_arrow_type(x.type, prefer_timestamp_ntz=True), x.nullable, {ID: int(given)} if given is not None else {}))
                    rows.append((uri, meta.metadata.num_rows, fingerprint(T.StructType(own)), ",".join(x.name for x in own)))
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["path", "n_rows", "schema", "columns"])

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return files_of(spark, folder).repartition(tasks).mapInArrow(read, "path string, n_rows long, schema string, columns string")


def projected(spark: SparkSession, schema: str, paths: list[str], evolved: T.StructType, defaults: dict[str, object]) -> DataFrame:
    """__path, __row and the evolved columns of files of one schema. Spark's reader finds columns by field id, under any name or place, as the types they have there;
    they are read under names that no file has, as the reader confuses the types of columns which swap their names."""
    types = {i: kind for i, _, kind, _ in json.loads(schema)}
    if None in types:
        raise ValueError(f"columns without a field id: {schema}")
    there = [f for f in evolved if f.metadata[ID] in types]
    fields = [T.StructField(f"__field_{f.metadata[ID]}", T._parse_datatype_string(types[f.metadata[ID]]), True, {ID: f.metadata[ID]}) for f in there]
    rows = spark.read.schema(T.StructType(fields)).parquet(*paths)
    meta = rows.metadataColumn("_metadata")
    rows = rows.select("*", meta["file_path"].alias("__path"), meta["row_index"].alias("__row"))
    there = {f.name for f in there}
    # a default depends on the row, else the column would be written as one that can't be null
    value = lambda f: F.col(f"__field_{f.metadata[ID]}") if f.name in there else F.when(F.col("__row") >= 0, F.lit(defaults.get(f.name)))
    return rows.select("__path", "__row", *[value(f).cast(f.dataType).alias(f.name, metadata=f.metadata) for f in evolved])


def rewrite(spark: SparkSession, folder: str, evolved: T.StructType, defaults: dict[str, object]) -> list[str]:
    """Bring all data files of the folder to the evolved schema (field ids in the columns' metadata); the paths that were rewritten.

    A column that a file lacks takes its value in ``defaults``, null where none is given; a column whose id isn't in the evolved schema is left out; types are cast as Spark casts them.
    Nulls stay nulls. A file without rows becomes an empty file of the evolved schema. A folder without files is left as it is. Files whose columns have no ids are an error, before anything is changed.
    """
    resume(spark, folder)
    drifted = footers(spark, folder).filter(F.col("schema") != fingerprint(evolved))
    groups = drifted.groupBy("schema").agg(F.sort_array(F.collect_list(F.when(F.col("n_rows") > 0, F.col("path")))).alias("full"), F.collect_list(F.when(F.col("n_rows") == 0, F.col("path"))).alias("empty")).orderBy("schema").limit(MOST_SCHEMAS + 1).collect()
    if len(groups) > MOST_SCHEMAS:
        raise ValueError(f"more than {MOST_SCHEMAS} distinct schemas in {folder}")
    if not groups:
        return []
    stage = f"{folder}/{STAGE}{uuid.uuid4().hex[:12]}"
    full, empty = [p for g in groups for p in g.full], [p for g in groups for p in g.empty]
    moves = spark.createDataFrame([], "staged string, path string")
    before = spark.conf.get("spark.sql.parquet.fieldId.read.enabled")
    spark.conf.set("spark.sql.parquet.fieldId.read.enabled", "true")
    try:
        if full:
            numbers = spark.createDataFrame([(p, i) for i, p in enumerate(full)], "__path string, __file int")
            rows = None
            for g in groups:
                if g.full:
                    part = projected(spark, g.schema, g.full, evolved, defaults)
                    rows = part if rows is None else rows.union(part)
            rows = rows.join(numbers, "__path").repartitionById(len(full), "__file").sortWithinPartitions("__file", "__row")
            rows.select(*[F.col(f"`{f.name}`").alias(f.name, metadata=f.metadata) for f in evolved]).write.parquet(f"{stage}/full")
            made = files_of(spark, f"{stage}/full").select(F.col("path").alias("staged"), F.regexp_extract("path", r"/part-(\d+)-[^/]*$", 1).cast("int").alias("__file"))
            moves = made.join(numbers, "__file").select("staged", F.col("__path").alias("path"))
    finally:
        spark.conf.set("spark.sql.parquet.fieldId.read.enabled", before)
    for i, path in enumerate(empty):  # Spark's writer leaves out tasks without rows, so that each needs its own
        spark.createDataFrame([], evolved).coalesce(1).write.parquet(f"{stage}/empty-{i}")
        moves = moves.union(files_of(spark, f"{stage}/empty-{i}").select(F.col("path").alias("staged"), F.lit(path).alias("path")))
    moves.write.parquet(f"{stage}/moves")
    _finish(spark, stage)
    return full + empty


def _finish(spark: SparkSession, stage: str) -> None:
    """Put staged files in the place of old ones. A move that was done already finds nothing staged."""

    def move(batches):
        from pyarrow import fs

        for b in batches:
            for staged, path in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                store, new = fs.FileSystem.from_uri(staged)
                _, old = fs.FileSystem.from_uri(path)
                there = lambda p, store=store: store.get_file_info(p).type == fs.FileType.File
                if there(new):
                    folder, _, name = old.rpartition("/")
                    if there(crc := f"{folder}/.{name}.crc"):  # the checksum that Spark keeps beside a local file
                        store.delete_file(crc)
                    if store.type_name != "local" and there(old):
                        store.delete_file(old)
                    try:
                        store.move(new, old)
                    except OSError:  # another attempt of this task was first
                        if there(new) or not there(old):
                            raise
            yield pa.RecordBatch.from_arrays([pa.array([len(b)], pa.int64())], names=["moved"])

    moves = spark.read.schema("staged string, path string").parquet(f"{stage}/moves")
    n = moves.count()
    moves.repartition(min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(1, n))).mapInArrow(move, "moved long").agg(F.sum("moved")).collect()
    _delete(spark, stage)


def _hadoop(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _delete(spark: SparkSession, folder: str) -> None:
    path, store = _hadoop(spark, folder)
    store.delete(path, True)


def resume(spark: SparkSession, folder: str) -> None:
    """Finish the rewrites of a folder whose moves were listed, and throw away those that had not come so far."""
    path, store = _hadoop(spark, f"{folder}/{STAGE}*")
    for status in store.globStatus(path) or []:
        stage = status.getPath().toString()
        done, _ = _hadoop(spark, f"{stage}/moves/_SUCCESS")
        if store.exists(done):
            _finish(spark, stage)
        else:
            _delete(spark, stage)

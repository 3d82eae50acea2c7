"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """As the session names it in spark.checkpoint.dir; a local one only where none is named and the master is local (tests)."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = getattr(spark.sparkContext, "_tessera_shared", None) or tempfile.mkdtemp(prefix="tessera_")
        spark.sparkContext._tessera_shared = named
    return named.rstrip("/")


def together(spark: SparkSession, call: Callable, items: Iterable) -> list:
    """What ``call`` gives for each item, with its Spark jobs beside those of the others."""
    items = list(items)
    with ThreadPoolExecutor(max(1, len(items))) as pool:
        return list(pool.map(inheritable_thread_target(spark)(call), items))


class Scratch:
    """Tables in a folder of their own below the shared one, to be read more than once or to end a long lineage; they survive the loss of executors and stay there."""

    def __init__(self, spark: SparkSession, name: str):
        self.folder, self.n = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}", 0

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.folder}/{self.n}"
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def write_all(self, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """The same for tables that don't come from each other."""
        paths = {name: f"{self.folder}/{self.n + i}" for i, name in enumerate(tables, 1)}
        self.n += len(tables)
        spark = next(iter(tables.values())).sparkSession
        together(spark, lambda name: tables[name].write.parquet(paths[name]), tables)
        return {name: spark.read.schema(df.schema).parquet(paths[name]) for name, df in tables.items()}

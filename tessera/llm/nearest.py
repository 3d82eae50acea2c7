"""Operator 12, approximate nearest neighbours: a hierarchical navigable small-world graph per shard, shard results merged.

Equal vectors are one point of the index with the smallest of their ids: no result can hold more of them, so that a vector which a third of all
rows share costs one point. Points are dealt to shards of bounded size by a hash; each shard's graph is built by one
task (hnsw.py) and written as flat arrays. A query goes to every shard; queries and shards meet in a grid of bounded cells, so that neither
the queries of a shard nor the shards of a query gather in one task. Each cell sends its best points; these are merged by windows.

Scale: vectors are shuffled twice (to tell equal ones, to their shards), queries once a shard. The cost of a query grows with the number of shards, and with the logarithm
of their size: choose ``shard_rows`` as large as the memory and patience of a task allow.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, need
from .hnsw import Graph

FOUND = "query_id long, rank int, vec_id long, score double"


def matrix(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Lists of numbers as rows of one matrix, the shorter ones with zeros behind."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    col = pa.concat_arrays(col.chunks) if isinstance(col, pa.ChunkedArray) else col
    size = np.diff(col.offsets.to_numpy())
    out = np.zeros((len(col), int(size.max(initial=0))))
    out[np.arange(out.shape[1])[None, :] < size[:, None]] = col.flatten().to_numpy()
    return out


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, v: rows with an id and a vector that takes part."""
    v = F.col("embedding").cast("array<double>")
    rows = need(rows, "vec_id", "embedding").select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))


def build(table: pa.Table) -> pa.Table:
    """The index of a shard, one row: vectors, ids and layers in the order of the graph's nodes."""
    x = matrix(table["v"])
    graph, order = Graph.build(x)
    column = lambda name: pa.array([table[name].to_numpy()[order].tobytes()], pa.binary())
    return pa.table(
        {
            "shard": table["shard"].slice(0, 1),
            "pids": column("pid"),
            "firsts": column("first"),
            "vectors": pa.array([x[order].tobytes()], pa.binary()),
            "lifted": pa.array([graph.vectors.tobytes()], pa.binary()),
            "layers": pa.array([[x.tobytes() for x in graph.layers]], pa.list_(pa.binary())),
            "widths": pa.array([[x.shape[1] for x in graph.layers]], pa.list_(pa.int32())),
        }
    )


INDEX = "shard int, pids binary, firsts binary, vectors binary, lifted binary, layers array<binary>, widths array<int>"


def searching(k: int, wide: int):
    """A cell of the grid: the ``k`` best points of a shard for each query, by exact scores of what the walk found; ties to the smaller first id."""

    def search(index: pa.Table, queries: pa.Table) -> pa.Table:
        out = []
        if index.num_rows and queries.num_rows:
            row = {c: index[c][0].as_py() for c in index.column_names}
            pids, firsts = np.frombuffer(row["pids"], np.int64), np.frombuffer(row["firsts"], np.int64)
            x = np.frombuffer(row["vectors"], np.float64).reshape(len(pids), -1)
            layers = [np.frombuffer(b, np.int32).reshape(-1, w) for b, w in zip(row["layers"], row["widths"], strict=True)]
            graph = Graph(np.frombuffer(row["lifted"], np.float32).reshape(len(pids), -1), layers)
            q, asked = matrix(queries["v"]), queries["pid"].to_numpy()
            q = np.pad(q, ((0, 0), (0, max(0, x.shape[1] - q.shape[1]))))[:, : x.shape[1]]
            for a in range(0, len(q), 256):
                part = q[a : a + 256]
                nodes = graph.search(part, wide)
                score = np.where(nodes >= 0, np.einsum("ijk,ik->ij", x[np.maximum(nodes, 0)], part), -np.inf)
                best = np.lexsort((firsts[np.maximum(nodes, 0)], -score), axis=1)[:, :k]
                nodes, score = np.take_along_axis(nodes, best, 1), np.take_along_axis(score, best, 1)
                r, c = np.nonzero(nodes >= 0)
                out.append((asked[a + r], pids[nodes[r, c]], firsts[nodes[r, c]], score[r, c]))
        query, pid, first, score = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, t) for t in ("i8", "i8", "i8", "f8"))
        return pa.table({"query": query, "pid": pid, "first": first, "score": score})

    return search


def nearest(spark: SparkSession, rows: DataFrame, k: int = 20, every: int = 20, shard_rows: int = 8192, shard_bytes: int = 64 << 20, wide: int = 128) -> DataFrame:
    """query_id, rank, vec_id, score: of each row whose vec_id is divisible by ``every`` the ``k`` nearest others that are found.

    Nearness is the inner product, summed in double precision. wide: the candidates that a walk holds in each shard; more of them give a higher recall.
    Rows with a null id, and vectors that are null, empty, zero or hold null or non-finite components, take no part, as query or as candidate. Vectors of different lengths count as if the shorter
    had zeros behind. Rows that are equal in id and vector are one; rows that share an id alone are rows of their own, each candidate of the other.
    With no more than ``k`` others, all are returned; an empty table gives no row.
    """
    scratch = Scratch(spark, "nearest")
    rows = usable(rows)
    trimmed = rows.withColumn("r", F.dense_rank().over(Window.partitionBy("v").orderBy("vec_id"))).filter(F.col("r") <= k + 1)
    points = scratch.write(trimmed.groupBy("v").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")).select(F.monotonically_increasing_id().alias("pid"), "v", "ids"))
    n, size = points.agg(F.count(F.lit(1)), F.coalesce(F.sum(8 * F.size("v").cast("long")), F.lit(0))).first()
    if not n:
        return spark.createDataFrame([], FOUND)
    shards = max(1, math.ceil(n / shard_rows), math.ceil(size / shard_bytes))
    asks = rows.filter(F.col("vec_id") % every == 0).join(points.select("pid", "v"), "v").select(F.col("vec_id").alias("query_id"), "pid").distinct()
    asks = scratch.write(asks)
    asked = scratch.write(asks.select("pid").distinct().join(points.select("pid", "v"), "pid"))
    cells = max(1, math.ceil(asked.count() / 4096))
    dealt = points.select(F.pmod(F.xxhash64("pid"), F.lit(shards)).cast("int").alias("shard"), "pid", F.get("ids", F.lit(0)).alias("first"), "v")
    index = scratch.write(dealt.groupBy("shard").applyInArrow(build, INDEX))
    left = index.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
    right = asked.withColumn("cell", F.pmod(F.xxhash64("pid"), F.lit(cells)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    on = ["shard", "cell"]
    found = left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(searching(k + 1, max(wide, k + 1)), "query long, pid long, first long, score double")
    found = scratch.write(found)
    best = Window.partitionBy("query").orderBy(F.desc("score"), "first")
    found = found.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1).join(points.select("pid", "ids"), "pid")
    one = F.struct((-F.col("score")).alias("s"), F.col("vec_id"), F.col("found"))
    lists = found.select("query", "score", F.col("pid").alias("found"), F.explode("ids").alias("vec_id")).groupBy("query").agg(F.slice(F.sort_array(F.collect_list(one)), 1, k + 1).alias("near"))
    others = F.filter("near", lambda x: ~((x["vec_id"] == F.col("query_id")) & (x["found"] == F.col("pid"))))
    out = asks.join(lists.withColumnRenamed("query", "pid"), "pid").select("query_id", F.posexplode(F.slice(others, 1, k)).alias("rank", "x"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score"))

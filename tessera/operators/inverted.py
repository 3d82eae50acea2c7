"""A vector index of inverted lists: trained centroids, every vector filed under the nearest one, and queries that look through several lists.

Centroids are trained by k-means on a bounded sample (``sample`` vectors, those with the smallest hashes of their ids); every vector is filed. Lists that hold more than ``cell``
vectors are dealt to cells by a hash, and queries go to all cells of their lists, so that no task holds a whole large list. Cells and the queries that probe
them meet in one shuffle; a cell compares by one product of matrices and sends its best for each query.

What a search compares is the sum of the lists it probes and the centroids, told with the result: the share falls with more lists, and the recall with fewer probes. Where vectors
have no clusters no choice of lists helps: there a recall of 0.9 takes more than half of all pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalised_vector


def rows_of(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    col = pa.concat_arrays(col.chunks) if isinstance(col, pa.ChunkedArray) and col.num_chunks else col
    n = len(col)
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


@dataclass
class InvertedLists:
    centroids: np.ndarray  # lists x dimensions, sent with the tasks: bounded by what a sample can train
    filed: DataFrame  # list, cell, id, v
    cells: DataFrame  # list, size, cells

    @classmethod
    def build(cls, vectors: DataFrame, lists: int, sample: int = 20_000, cell: int = 4096, seed: int = 5, write=lambda df: df) -> InvertedLists:
        """vectors: id long, v (not null, not zero, one length). write: puts a table where it can be read again, for an index that is searched more than once."""
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        own = vectors.select("id", normalised_vector(F.col("v")).alias("v"))
        some = own.orderBy(F.xxhash64("id"), "id").limit(sample).select(array_to_vector("v").alias("features"))
        some = some.repartition(8).cache()
        model = KMeans(k=lists, seed=seed, distanceMeasure="cosine", maxIter=8).fit(some)
        some.unpersist()
        centroids = np.array(model.clusterCenters())
        centroids /= np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-12)

        def file(batches):
            for b in batches:
                nearest = (rows_of(b.column(1)) @ centroids.T).argmax(axis=1) if len(b) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([pa.array(nearest.astype(np.int32)), b.column(0), b.column(1)], names=["list", "id", "v"])

        filed = write(own.mapInArrow(file, "list int, id long, v array<double>"))
        cells = write(filed.groupBy("list").agg(F.count(F.lit(1)).alias("size")).withColumn("cells", F.ceil(F.col("size") / cell).cast("int")))
        filed = filed.join(cells.select("list", "cells"), "list").withColumn("cell", F.pmod(F.xxhash64("id"), F.col("cells")).cast("int")).drop("cells")
        return cls(centroids, filed, cells)

    def search(self, queries: DataFrame, k: int, probes: int) -> DataFrame:
        """query_id, id, similarity, rank, compared: of each query (query_id long, v) the ``k`` nearest others of the ``probes`` nearest lists, and how many vectors and centroids it was compared with."""
        centroids, probes = self.centroids, min(probes, len(self.centroids))

        def probe(batches):
            for b in batches:
                if not len(b):
                    continue
                near = np.argsort(-(rows_of(b.column(1)) @ centroids.T), axis=1, kind="stable")[:, :probes].astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(near), pa.list_(pa.int32()))], names=["query_id", "q", "lists"])

        def compare(left: pa.Table, right: pa.Table) -> pa.Table:
            query, ids, sims, compared = [], [], [], []
            if left.num_rows and right.num_rows:
                x, own, asked, q = rows_of(left["v"]), left["id"].to_numpy(), right["query_id"].to_numpy(), rows_of(right["q"])
                for a in range(0, len(q), 256):
                    s = q[a : a + 256] @ x.T
                    s[own[None, :] == asked[a : a + 256, None]] = -np.inf
                    best = np.lexsort((np.broadcast_to(own, s.shape), -np.round(s, 9)), axis=1)[:, :k]
                    query.append(np.repeat(asked[a : a + 256], best.shape[1]))
                    ids.append(own[best].ravel())
                    sims.append(np.take_along_axis(s, best, 1).ravel())
                    compared.append(np.repeat([len(x)], best.size) * (np.arange(best.size) % best.shape[1] == 0))  # told once a query and cell
            query, ids, sims, compared = (np.concatenate(c) if c else np.zeros(0, t) for c, t in ((query, "i8"), (ids, "i8"), (sims, "f8"), (compared, "i8")))
            return pa.table({"query_id": query, "id": ids, "similarity": sims, "compared": compared})

        asked = queries.select("query_id", normalised_vector(F.col("v")).alias("v")).mapInArrow(probe, "query_id long, q array<double>, lists array<int>")
        asked = asked.select("query_id", "q", F.explode("lists").alias("list")).join(self.cells, "list").withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
        on = ["list", "cell"]
        found = self.filed.groupBy(*on).cogroup(asked.groupBy(*on)).applyInArrow(compare, "query_id long, id long, similarity double, compared long")
        w = Window.partitionBy("query_id")
        ranked = found.withColumn("rank", F.row_number().over(w.orderBy(F.desc(F.round("similarity", 9)), "id"))).withColumn("compared", F.sum("compared").over(w) + len(centroids))
        return ranked.filter((F.col("rank") <= k) & (F.col("similarity") > float("-inf"))).select("query_id", "id", "similarity", "rank", "compared")


def recall(found: DataFrame, exact: DataFrame, n: int) -> DataFrame:
    """One row: queries, recall of the ids of ``exact`` (query_id, id) among those found, share of the n vectors that a query was compared with on average."""
    hit = exact.join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left").agg(F.count_distinct("query_id").alias("queries"), (F.count("hit") / F.count(F.lit(1))).alias("recall"))
    share = found.groupBy("query_id").agg(F.max("compared").alias("c")).agg((F.avg("c") / n).alias("share"))
    return hit.join(share)  # rows of one

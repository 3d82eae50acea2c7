"""Ranks within groups of any size: no task sees a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import Scratch

#: monotonically_increasing_id() holds the partition above this bit, the row's place in it below.
PLACE_BITS = 33


def ranked(rows: DataFrame, group: Sequence[str], order: Sequence[Column], scratch: Scratch, name: str = "rank") -> DataFrame:
    """rows with ``name``: the row's number, from 1, among those of its group. The order must tell all rows of a group apart.

    A range shuffle by group and order cuts a hot group into as many tasks as its rows need. A row's number is its place in its task, less the place where its
    group begins there, and the rows that the group has in earlier tasks: running sums over one count a task and group. Rows are written before they are
    shuffled, as ranges are found by a sample of them, and with their places, so that counts and rows agree whatever executor is lost. An empty table gives no rows; nulls of the group are one group.
    """
    rows = scratch.write(rows)
    placed = rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order).withColumn("_place", F.monotonically_increasing_id())
    placed = scratch.write(placed.withColumn("_task", F.shiftright("_place", PLACE_BITS)))
    counts = placed.groupBy(*group, "_task").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + 1).select(*[F.col(g).alias(f"_g_{g}") for g in group], F.col("_task").alias("_t"), "_before")
    same = [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group]
    out = placed.join(counts, [*same, F.col("_task") == F.col("_t")])
    return out.select(*rows.columns, (F.col("_place") + F.col("_before")).alias(name))

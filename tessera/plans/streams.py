"""Queries that stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.cards import table
from ..sources.scratch import shared_dir
from ..streaming import leases
from .registry import register

#: What the events of the tables command: every user has an outbox.
COMMANDS = {"signup": "emit", "view": "claim", "click": "claim", "purchase": "ack", "error": "fail"}
SLICES, DELAY_DAYS, LEASE, UNIT = 4, 8, 43_200, 60
_MILLIS = "epoch_us(max(ts)) // 1000"
_FOLD = leases.fold_sql(
    "(SELECT user_id AS key, event_id AS id, epoch_us(ts) AS micros, CASE event_type " + " ".join(f"WHEN '{k}' THEN '{c}'" for k, c in COMMANDS.items()) + " END AS kind FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL)",
    f"(SELECT {_MILLIS} - {DELAY_DAYS * 86_400_000} FROM events)",
    LEASE,
    UNIT,
)


@register(_FOLD, cards=False)
def outbox_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outboxes of all users after a stream over ``events``, started anew on one checkpoint for each of four slices of time.

    Every tenth event comes a slice late, within the watermark's delay; the state is that of all commands before the watermark.
    """
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type").filter("ts IS NOT NULL")
    first, last = e.agg(F.min("ts"), F.max("ts")).first()
    folder = f"{shared_dir(spark)}/outbox-{uuid.uuid4().hex[:12]}"
    commands = e.select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("ts").alias("at"), leases.command(F.col("event_type"), COMMANDS).alias("kind"))
    if first is not None:
        width = max((last - first).total_seconds() / SLICES, 1e-6)
        at = F.floor((F.unix_micros("at") - F.unix_micros(F.lit(first))) / F.lit(width * 1e6)) + (F.col("id") % 10 == 0).cast("int")
        sliced = commands.withColumn("slice", F.least(F.greatest(at, F.lit(0)), F.lit(SLICES - 1)))
        for i in range(SLICES):
            sliced.filter(F.col("slice") == i).drop("slice").write.mode("append").parquet(f"{folder}/in")
            stream = spark.readStream.schema(commands.schema).parquet(f"{folder}/in")
            leases.run(stream, f"{folder}/out", f"{folder}/checkpoint", f"{DELAY_DAYS} days", LEASE, UNIT)
    told = spark.read.schema(leases.TRANSITIONS).parquet(f"{folder}/out") if first is not None else spark.createDataFrame([], leases.TRANSITIONS)
    return leases.latest(told).select("key", "round", "status", "attempts", "available_at", "claims", "published", "expired", "refused")

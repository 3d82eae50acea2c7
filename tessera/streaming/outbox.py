"""The outbox: claim, acknowledge, fail, route and drain as pure functions of state, and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import backoff_seconds

LEASE_SECONDS = 300


def claim(outbox: DataFrame, as_of: str, limit: int = 50) -> DataFrame:
    """The oldest events that are due and not leased, with a lease and one more attempt; at most 500."""
    now = F.to_timestamp(F.lit(as_of))
    free = F.col("claimed_at").isNull() | (F.col("claimed_at") < now - F.expr(f"INTERVAL {LEASE_SECONDS} SECONDS"))
    due = outbox.filter(F.col("published_at").isNull() & (F.col("available_at") <= now) & free)
    return due.orderBy("created_at", "event_id").limit(min(max(limit, 1), 500)).withColumn("claimed_at", now).withColumn("attempts", F.col("attempts") + 1)


def fail(claimed: DataFrame, as_of: str) -> DataFrame:
    """Leases cleared, the next attempt after a quadratic delay."""
    now = F.to_timestamp(F.lit(as_of))
    wait = backoff_seconds(F.col("attempts"))
    return claimed.withColumn("available_at", F.timestamp_seconds(F.unix_timestamp(now) + wait)).withColumn("claimed_at", F.lit(None).cast("timestamp"))


def acknowledge(claimed: DataFrame, as_of: str) -> DataFrame:
    return claimed.withColumn("published_at", F.to_timestamp(F.lit(as_of))).withColumn("claimed_at", F.lit(None).cast("timestamp"))


def idempotent(events: DataFrame, key: str | list[str], at: str, delay: str = "10 minutes") -> DataFrame:
    """One event of each key: the first by ``at``, of those at one time the least in its other columns; on a stream the first that comes, with state bounded by the watermark."""
    keys = [key] if isinstance(key, str) else key
    if events.isStreaming:
        return events.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)
    rest = [at, *[c for c in events.columns if c not in (at, *keys)]]
    return events.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("x")).select(*keys, "x.*").select(*events.columns)


def drain(events: DataFrame, sink, checkpoint: str):
    """Run ``sink(batch, id)`` on all events that are there, then stop."""
    return events.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def poll(events: DataFrame, sink, checkpoint: str, every: str = "10 seconds"):
    """As ``drain``, and then again and again."""
    return events.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def after(outbox: DataFrame, claimed: DataFrame, done: DataFrame, as_of: str) -> DataFrame:
    """The outbox after a round: claimed events of which ``done`` (event_id, error) tells the outcome, null for a success, are acknowledged or failed with the error kept; all others stay."""
    told = claimed.join(done, "event_id")
    ok = acknowledge(told.filter("error is null"), as_of).withColumn("last_error", F.lit(None).cast("string")).drop("error")
    bad = fail(told.filter("error is not null"), as_of).withColumn("last_error", F.col("error")).drop("error")
    rest = outbox.join(told.select("event_id"), "event_id", "left_anti")
    return rest.unionByName(ok.unionByName(bad), allowMissingColumns=True)


def route(event_type, payload, revision_key: str, indexed: tuple[str, ...], skipped: tuple[str, ...]) -> F.Column:
    """index: an event of a kind that names its revision; payload: one whose payload does; skip: a known kind without one; fail: anything else."""
    return F.when(event_type.isin(*indexed), "index").when(F.get_json_object(payload, f"$.{revision_key}").isNotNull(), "payload").when(event_type.isin(*skipped), "skip").otherwise("fail")


def freshness(outbox: DataFrame, locales: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """One row: outbox_pending, locales_without_embedding."""
    without = locales.join(vectors.select(key).distinct(), key, "left_anti").agg(F.count(F.lit(1)).alias("locales_without_embedding"))
    return outbox.agg(F.count_if(F.col("published_at").isNull()).alias("outbox_pending")).join(without)  # rows of one

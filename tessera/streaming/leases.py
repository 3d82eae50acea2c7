"""The outbox as a stream: keyed state with timers for leases that run out and events that may be tried again.

Commands (key, id, at, kind) come in any order within the watermark's delay. They wait in the state of their bucket of keys until the watermark has passed them and are then
applied by time, so that the outcome doesn't depend on the batches they came in: it is the fold of all commands before the watermark.

    emit   opens an event, or the next one of its key once the one before is published
    claim  leases an event that is pending and due
    ack    publishes a leased event
    fail   makes it pending again, due after a delay that grows with the square of its attempts, 300 units at most

A lease that is neither acknowledged nor failed in time expires. A command that the state doesn't allow is refused, counted, and changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

KINDS = ("emit", "claim", "ack", "fail")
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What a transition tells: the state of the key after it. Times are microseconds since 1970.
TRANSITIONS = "key long, seq long, at long, action string, round int, status string, attempts int, available_at long, lease_until long, claims int, published int, expired int, refused int"
STATUSES = ("none", "pending", "leased", "published")
ACTIONS = ("emitted", "claimed", "published", "failed", "expired", "refused")
MOST_ATTEMPTS_SQUARED = 300
#: Columns whose values are packed as places.
NAMED = {"action": ACTIONS, "status": STATUSES}


def record(columns: str) -> np.dtype:
    """The packed form of rows; names are places in ``NAMED``."""
    return np.dtype([(n, "i1" if n in NAMED else "<i8" if t == "long" else "<i4") for n, t in (c.split() for c in columns.split(", "))])


TOLD = record(TRANSITIONS)
ITEM = record("key long, seq long, round int, status string, attempts int, available_at long, lease_until long, claims int, published int, expired int, refused int")
COMMAND = np.dtype([("key", "<i8"), ("at", "<i8"), ("id", "<i8"), ("kind", "i1")])  # kind: its place in sorted KINDS
NO_ID = 2**63 - 1  # a command without an id comes last of its time
AT_ONCE = 10_000


class Item(NamedTuple):
    """The state of a key."""

    seq: int = 0
    round: int = 0
    status: str = "none"
    attempts: int = 0
    available_at: int = 0
    lease_until: int = 0
    claims: int = 0
    published: int = 0
    expired: int = 0
    refused: int = 0

    def lapsed(self) -> Item:
        return self._replace(seq=self.seq + 1, status="pending", available_at=self.lease_until, expired=self.expired + 1)

    def told(self, kind: str, at: int, lease: int, unit: int) -> tuple[str, Item]:
        """(what was done, the state after it) for a command at a time when no lease has run out unseen."""
        seq = self.seq + 1
        if kind == "emit" and self.status in ("none", "published"):
            return "emitted", self._replace(seq=seq, round=self.round + 1, status="pending", attempts=0, available_at=at)
        if kind == "claim" and self.status == "pending" and self.available_at <= at:
            return "claimed", self._replace(seq=seq, status="leased", attempts=self.attempts + 1, lease_until=at + lease, claims=self.claims + 1)
        if kind == "ack" and self.status == "leased":
            return "published", self._replace(seq=seq, status="published", published=self.published + 1)
        if kind == "fail" and self.status == "leased":
            return "failed", self._replace(seq=seq, status="pending", available_at=at + min(self.attempts * self.attempts, MOST_ATTEMPTS_SQUARED) * unit)
        return "refused", self._replace(seq=seq, refused=self.refused + 1)


def leases(lease_seconds: int, unit_seconds: int):
    """What is done for a bucket of keys with new commands, or whose time has come: of each key, the commands before the watermark in their order. One timer a bucket: the time of its first waiting command, or of the first end of a lease."""
    lease, unit = lease_seconds * 1_000_000, unit_seconds * 1_000_000
    kinds = sorted(KINDS)

    def step(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        items, waiting = state.get if state.exists else (b"", b"")
        of = {key: Item(seq, round_, STATUSES[status], *more) for key, seq, round_, status, *more in np.frombuffer(items, ITEM).tolist()}
        now, out = state.getCurrentWatermarkMs(), []
        parts = [np.frombuffer(waiting, COMMAND)]
        for f in () if state.hasTimedOut else frames:
            new = np.empty(len(f), COMMAND)
            new["key"], new["at"], new["id"], new["kind"] = f["key"], f["micros"], f["id"], f["kind"]
            parts.append(new)
        all_ = np.concatenate(parts)
        before = all_["at"] < now * 1000  # earlier than the watermark's millisecond
        due, left = all_[before], all_[~before]
        due = due[np.lexsort((due["kind"], due["id"], due["at"], due["key"]))]

        def tell(key: int, action: str, at: int, item: Item) -> None:
            out.append((key, item.seq, at, ACTIONS.index(action), item.round, STATUSES.index(item.status), *item[3:]))
            of[key] = item

        def packed() -> pd.DataFrame:
            rows = np.array(out, TOLD).tobytes()
            out.clear()
            return pd.DataFrame({"told": [rows]})

        for a in range(0, len(due), AT_ONCE):
            for key, at, _id, kind in due[a : a + AT_ONCE].tolist():
                item = of.get(key) or Item()
                if item.status == "leased" and item.lease_until <= at:
                    item = item.lapsed()
                    tell(key, "expired", item.lease_until, item)
                action, item = item.told(kinds[kind], at, lease, unit)
                tell(key, action, at, item)
            yield packed()
        for key, item in of.items():
            if item.status == "leased" and item.lease_until // 1000 < now:
                tell(key, "expired", item.lease_until, item.lapsed())
        if out:
            yield packed()
        rows = np.array([(k, i.seq, i.round, STATUSES.index(i.status), *i[3:]) for k, i in of.items()], ITEM)
        state.update((rows.tobytes(), left.tobytes()))
        times = np.concatenate((left["at"], rows["lease_until"][rows["status"] == STATUSES.index("leased")]))
        if len(times):
            state.setTimeoutTimestamp(max(1, int(times.min()) // 1000))

    return step


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each transition."""
    for b in batches:
        for packed in b.column(0):
            rows, out = np.frombuffer(packed.as_py(), TOLD), {}
            for n in TOLD.names:
                own = pa.array(np.ascontiguousarray(rows[n]))
                out[n] = pa.DictionaryArray.from_arrays(own, pa.array(NAMED[n])).cast(pa.string()) if n in NAMED else own
            yield pa.RecordBatch.from_pydict(out)


def transitions(commands: DataFrame, delay: str, lease_seconds: int = 300, unit_seconds: int = 1, buckets: int = 1024) -> DataFrame:
    """The stream of transitions of a stream of commands: key long, id long, at timestamp, kind. Rows without a key, time or known kind are left out; commands later than ``delay`` are dropped, as with any watermark.

    A call of Python and of the state store costs milliseconds, so that it is made for a bucket of keys and not for each key. As with the shuffle partitions of a stream, ``buckets`` stays what it was when a checkpoint began.
    """
    known = commands.filter(F.col("key").isNotNull() & F.col("at").isNotNull() & F.col("kind").isin(*KINDS))
    place = F.array_position(F.array(*[F.lit(k) for k in sorted(KINDS)]), F.col("kind")) - 1
    own = known.select("key", F.coalesce("id", F.lit(NO_ID)).alias("id"), "at", place.alias("kind"), F.unix_micros("at").alias("micros"), F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket")).withWatermark("at", delay)
    told = own.groupBy("bucket").applyInPandasWithState(leases(lease_seconds, unit_seconds), "told binary", "items binary, waiting binary", "append", GroupStateTimeout.EventTimeTimeout)
    return told.mapInArrow(unpacked, TRANSITIONS)


def run(commands: DataFrame, out: str, checkpoint: str, delay: str, lease_seconds: int = 300, unit_seconds: int = 1) -> None:
    """Apply all commands that are there and stop; started again on the same checkpoint, it goes on where it ended. Transitions are appended to the Parquet folder ``out``, each once."""
    spark = commands.sparkSession
    conf = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(conf)
    spark.conf.set(conf, ROCKS)
    try:
        q = transitions(commands, delay, lease_seconds, unit_seconds).writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
        q.awaitTermination()
    finally:
        spark.conf.set(conf, before)


def latest(told: DataFrame) -> DataFrame:
    """The state of each key after its last transition."""
    columns = [c for c in told.columns if c not in ("key", "seq")]
    return told.groupBy("key").agg(F.max_by(F.struct(*columns), "seq").alias("x")).select("key", *[F.col(f"x.{c}") for c in columns])


def fold_sql(commands: str, before: str, lease_seconds: int, unit_seconds: int) -> str:
    """The same fold as recursive SQL over a relation ``commands`` (key, id, micros, kind): of all commands of a millisecond earlier than the expression ``before``."""
    lease, unit = lease_seconds * 1_000_000, unit_seconds * 1_000_000
    lapsed = "(f.status = 'leased' AND f.lease_until <= p.micros)"
    st = f"CASE WHEN {lapsed} THEN 'pending' ELSE f.status END"
    due = f"CASE WHEN {lapsed} THEN f.lease_until ELSE f.available_at END"
    emit = f"(p.kind = 'emit' AND {st} IN ('none', 'published'))"
    claim = f"(p.kind = 'claim' AND {st} = 'pending' AND {due} <= p.micros)"
    ack, fail = (f"(p.kind = '{k}' AND {st} = 'leased')" for k in ("ack", "fail"))
    return f"""WITH RECURSIVE w AS (SELECT {before} AS w), p AS (SELECT key, micros, kind, row_number() OVER (PARTITION BY key ORDER BY micros, id, kind) AS n FROM {commands}, w WHERE micros // 1000 < w),
    f AS (SELECT DISTINCT key, 0::BIGINT AS n, 0 AS round, 'none' AS status, 0 AS attempts, 0::BIGINT AS available_at, 0::BIGINT AS lease_until, 0 AS claims, 0 AS published, 0 AS expired, 0 AS refused FROM p
      UNION ALL SELECT f.key, p.n, f.round + {emit}::INT, CASE WHEN {emit} OR {fail} THEN 'pending' WHEN {claim} THEN 'leased' WHEN {ack} THEN 'published' ELSE {st} END,
        CASE WHEN {emit} THEN 0 ELSE f.attempts + {claim}::INT END, CASE WHEN {emit} THEN p.micros WHEN {fail} THEN p.micros + least(f.attempts * f.attempts, {MOST_ATTEMPTS_SQUARED})::BIGINT * {unit} ELSE {due} END,
        CASE WHEN {claim} THEN p.micros + {lease} ELSE f.lease_until END, f.claims + {claim}::INT, f.published + {ack}::INT, f.expired + {lapsed}::INT, f.refused + (NOT ({emit} OR {claim} OR {ack} OR {fail}))::INT
      FROM f JOIN p ON p.key = f.key AND p.n = f.n + 1),
    z AS (SELECT *, status = 'leased' AND lease_until // 1000 < (SELECT w FROM w) AS out FROM f QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC) = 1)
    SELECT key, round, CASE WHEN out THEN 'pending' ELSE status END AS status, attempts, CASE WHEN out THEN lease_until ELSE available_at END AS available_at, claims, published, expired + out::INT AS expired, refused FROM z"""


def command(kind: Column, names: dict[str, str]) -> Column:
    """The command that an event's kind stands for; null for others."""
    return F.coalesce(*[F.when(kind == k, c) for k, c in names.items()])

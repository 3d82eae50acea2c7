"""The streamed outbox against a fold in Python, in any slicing of its input."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tessera.streaming import leases

START = datetime.datetime(2024, 5, 1)


def micros(t):
    return (t - datetime.datetime(1970, 1, 1)) // datetime.timedelta(microseconds=1)


def fold(commands, before_ms, lease, unit):
    """key to (round, status, attempts, available_at, claims, published, expired, refused), written from the rules alone."""
    out = {}
    for key, _, at, kind in sorted(commands, key=lambda c: (c[2], c[1], c[3])):
        t = micros(at)
        if t // 1000 >= before_ms:
            continue
        s = out.setdefault(key, dict(round=0, status="none", attempts=0, available_at=0, claims=0, published=0, expired=0, refused=0, until=0))
        if s["status"] == "leased" and s["until"] <= t:
            s.update(status="pending", available_at=s["until"], expired=s["expired"] + 1)
        ok = {"emit": s["status"] in ("none", "published"), "claim": s["status"] == "pending" and s["available_at"] <= t, "ack": s["status"] == "leased", "fail": s["status"] == "leased"}[kind]
        if not ok:
            s["refused"] += 1
        elif kind == "emit":
            s.update(round=s["round"] + 1, status="pending", attempts=0, available_at=t)
        elif kind == "claim":
            s.update(status="leased", attempts=s["attempts"] + 1, until=t + lease * 10**6, claims=s["claims"] + 1)
        elif kind == "ack":
            s.update(status="published", published=s["published"] + 1)
        else:
            s.update(status="pending", available_at=t + min(s["attempts"] ** 2, 300) * unit * 10**6)
    for s in out.values():
        if s["status"] == "leased" and s["until"] // 1000 < before_ms:
            s.update(status="pending", available_at=s["until"], expired=s["expired"] + 1)
        del s["until"]
    return {k: tuple(s.values()) for k, s in out.items()}


@pytest.mark.parametrize("slices", [3])
def test_stream_equals_fold(spark, tmp_path, slices):
    rng = random.Random(3)
    rows = [(rng.randrange(6), i, START + datetime.timedelta(microseconds=rng.randrange(4 * 3600 * 10**6)), rng.choice(["emit", "claim", "claim", "ack", "fail", "claim"])) for i in range(400)]
    rows += [(7, 1000, START, "emit"), (7, 1001, START, "claim"), (8, 1002, START, "ack")]
    broken = [(None, 2000, START, "emit"), (1, 2001, None, "claim"), (1, 2002, START, "odd"), (1, 2003, START, None)]
    df = spark.createDataFrame(rows + broken, "key long, id long, at timestamp, kind string")
    where = str(tmp_path)
    order = rows + broken
    # a slice of time each start, but every fifth row comes with the next one
    at = [min(slices - 1, int(((r[2] or START) - START).total_seconds() / (4 * 3600 / slices)) + (i % 5 == 0)) for i, r in enumerate(order)]
    for s in range(slices):
        spark.createDataFrame([r for r, k in zip(order, at) if k == s], df.schema).coalesce(1).write.mode("append").parquet(f"{where}/in")
        stream = spark.readStream.schema(df.schema).parquet(f"{where}/in")
        leases.run(stream, f"{where}/out", f"{where}/checkpoint", "150 minutes", lease_seconds=120, unit_seconds=60)
    told = spark.read.schema(leases.TRANSITIONS).parquet(f"{where}/out")
    before = micros(max(r[2] for r in rows)) // 1000 - 150 * 60_000
    got = {r.key: (r.round, r.status, r.attempts, r.available_at, r.claims, r.published, r.expired, r.refused) for r in leases.latest(told).collect()}
    want = fold(rows, before, 120, 60)
    assert got == want and any(x[6] for x in want.values()) and any(x[5] for x in want.values())
    per = told.groupBy("key").agg(F.count("*").alias("n"), F.max("seq").alias("m"), F.count_distinct("seq").alias("d")).collect()
    assert all(r.n == r.m == r.d for r in per)  # each transition once, none missing

"""The streamed outbox keeps its state by buckets of keys, so that calls and state rows don't grow with the keys."""

import datetime
import random

from tessera.streaming import leases
from tests.test_streams import START, fold, micros

KEYS, BUCKETS = 300, 5


def test_state_rows_are_buckets(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.randrange(KEYS), i, START + datetime.timedelta(seconds=rng.randrange(4 * 3600)), rng.choice(["emit", "claim", "ack", "fail"])) for i in range(3000)]
    rows += [(KEYS, None, START, "claim"), (KEYS, 9000, START, "emit"), (KEYS, None, START, "claim")]  # without an id: behind those of the same time
    where = str(tmp_path)
    df = spark.createDataFrame(rows, "key long, id long, at timestamp, kind string")
    df.coalesce(1).write.parquet(f"{where}/in")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", leases.ROCKS)
    try:
        told = leases.transitions(spark.readStream.schema(df.schema).parquet(f"{where}/in"), "1 hour", 120, 60, buckets=BUCKETS)
        q = told.writeStream.format("parquet").option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True).start(f"{where}/out")
        q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= BUCKETS
    got = {r.key: (r.round, r.status, r.attempts, r.available_at, r.claims, r.published, r.expired, r.refused) for r in leases.latest(spark.read.schema(leases.TRANSITIONS).parquet(f"{where}/out")).collect()}
    known = [(k, leases.NO_ID if i is None else i, at, kind) for k, i, at, kind in rows]
    assert got == fold(known, micros(max(r[2] for r in rows)) // 1000 - 3_600_000, 120, 60)
    assert got[KEYS][4] == 1 and got[KEYS][7] == 1

"""Imports, mutations, reconciliation, coverage and the outbox."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import backoff_seconds
from ..operators import state
from ..sources.cards import cards, table
from ..streaming import outbox
from .registry import register

AS_OF = "2024-01-20 00:00:00"


def with_checkpoints(spark: SparkSession) -> None:
    """checkpoint() needs a folder: the one the session names, else (tests) one of our own."""
    import tempfile

    if not spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        return
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessera_"))


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A state and a change that overlap: documents not divisible by five; those not divisible by three, with every seventh changed."""
    c = cards(spark, sf_dir, "doc_id", "content_hash", "topic")
    return c.filter("doc_id % 5 <> 0"), c.filter("doc_id % 3 <> 0").withColumn("content_hash", F.when(F.col("doc_id") % 7 == 0, "changed").otherwise(F.col("content_hash")))


_HALVES = ", s AS (SELECT doc_id, content_hash, topic FROM cards WHERE doc_id % 5 <> 0), c AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'changed' ELSE content_hash END AS content_hash, topic FROM cards WHERE doc_id % 3 <> 0)"


@register(f"{_HALVES} SELECT doc_id, CASE WHEN c.doc_id IS NULL THEN s.content_hash ELSE c.content_hash END AS content_hash, coalesce(c.topic, s.topic) AS topic, CASE WHEN s.doc_id IS NULL THEN 'created' WHEN c.doc_id IS NULL THEN 'kept' WHEN s.content_hash = c.content_hash THEN 'unchanged' ELSE 'updated' END AS action FROM s FULL JOIN c USING (doc_id) /* FROM cards */")
def upsert_latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.upsert(*_halves(spark, sf_dir), "doc_id")


@register(f"{_HALVES} SELECT CASE WHEN s.doc_id IS NULL THEN 'created' WHEN c.doc_id IS NULL THEN 'kept' WHEN s.content_hash = c.content_hash THEN 'unchanged' ELSE 'updated' END AS action, count(*) AS n FROM s FULL JOIN c USING (doc_id) GROUP BY 1 /* FROM cards */")
def import_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert_latest_wins(spark, sf_dir).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@register(f"{_HALVES} SELECT CASE WHEN s.doc_id IS NULL THEN 'missing' WHEN c.doc_id IS NULL THEN 'extra' WHEN s.content_hash = c.content_hash THEN 'covered' ELSE 'stale' END AS state, count(*) AS n FROM s FULL JOIN c USING (doc_id) GROUP BY 1 /* FROM cards */")
def mapping_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, c = _halves(spark, sf_dir)
    return state.reconcile(m, c, "doc_id", "content_hash").groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@register("SELECT c.doc_id, CASE WHEN c.doc_id % 2 = 0 AND c.doc_id % 3 = 0 THEN 'archived' WHEN c.doc_id % 2 = 0 THEN 'published' ELSE 'draft' END AS status FROM cards c")
def archive_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cards(spark, sf_dir, "doc_id").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "published").otherwise("draft").alias("status"))
    return state.archive_missing(c, c.filter("doc_id % 3 <> 0"), "doc_id")


@register("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'ok' WHEN (o_orderstatus = 'F') = (o_orderkey % 2 = 0) THEN 'noop' ELSE 'conflict' END AS result, CASE WHEN o_orderstatus = 'O' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'merge' ELSE 'keep' END WHEN o_orderstatus = 'F' THEN 'merge' ELSE 'keep' END AS decision FROM orders", cards=False)
def review_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    s = F.col("o_orderstatus")
    now = o.select("o_orderkey", F.when(s == "O", "open").when(s == "F", "merge").otherwise("keep").alias("decision"))
    want = o.select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "merge").otherwise("keep").alias("decision"))
    return state.decide(now, want, "o_orderkey")


@register(
    """, d AS (SELECT topic, level, locale, content_kind, CASE WHEN level IS NULL THEN 'needs_new' WHEN content_kind = 'fixture' THEN 'theory_only' ELSE 'bound' END AS disposition FROM cards)
    SELECT dim, key, disposition, count(*) AS n FROM (SELECT disposition, unnest([{'dim': 'topic', 'key': topic}, {'dim': 'locale', 'key': locale}, {'dim': 'kind', 'key': content_kind}, {'dim': 'level', 'key': coalesce(level, 'unmapped')}], recursive := true) FROM d) GROUP BY ALL /* FROM cards */"""
)
def binding_coverage_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dispositions by every dimension at once."""
    c = cards(spark, sf_dir, "topic", "locale", "content_kind", "level")
    disposition = F.when(F.col("level").isNull(), "needs_new").when(F.col("content_kind") == "fixture", "theory_only").otherwise("bound").alias("disposition")
    dims = F.array(*[F.struct(F.lit(d).alias("dim"), F.coalesce(v, F.lit("unmapped")).alias("key")) for d, v in (("topic", "topic"), ("locale", "locale"), ("kind", "content_kind"), ("level", "level"))])
    return c.select(disposition, F.inline(dims)).groupBy("dim", "key", "disposition").agg(F.count(F.lit(1)).alias("n"))


@register("SELECT p.p_brand AS target, count(DISTINCT l.l_orderkey) FILTER (WHERE l.l_returnflag = 'A') AS primary_n, count(DISTINCT l.l_orderkey) FILTER (WHERE l.l_returnflag = 'N') AS supporting_n, count(DISTINCT l.l_orderkey) FILTER (WHERE l.l_returnflag = 'A') >= 100 AS met FROM part p LEFT JOIN lineitem l ON l.l_partkey = p.p_partkey GROUP BY p.p_brand", cards=False)
def coverage_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, li = table(spark, sf_dir, "part").select("p_partkey", "p_brand"), table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_orderkey", "l_returnflag")
    of = lambda f: F.count_distinct(F.when(F.col("l_returnflag") == f, F.col("l_orderkey")))
    g = p.join(li, "p_partkey", "left").groupBy(F.col("p_brand").alias("target")).agg(of("A").alias("primary_n"), of("N").alias("supporting_n"))
    return g.withColumn("met", F.col("primary_n") >= 100)


@register("WITH a AS (SELECT n.n_nationkey, coalesce(r.r_name, n.n_name) AS canonical FROM nation n LEFT JOIN region r ON r.r_regionkey = n.n_regionkey AND n.n_nationkey % 2 = 0) SELECT canonical, count(*) AS n FROM a JOIN customer c ON c.c_nationkey = a.n_nationkey GROUP BY canonical", cards=False)
def alias_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r, c = (table(spark, sf_dir, t) for t in ("nation", "region", "customer"))
    alias = n.filter("n_nationkey % 2 = 0").join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "r_name")
    a = n.join(alias, "n_nationkey", "left").select("n_nationkey", F.coalesce("r_name", "n_name").alias("canonical"))
    return c.join(a, c.c_nationkey == a.n_nationkey).groupBy("canonical").agg(F.count(F.lit(1)).alias("n"))


def _outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    none = F.lit(None).cast("timestamp")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("created_at"), F.col("ts").cast("timestamp").alias("available_at"), F.when(F.col("event_id") % 4 == 0, F.to_timestamp(F.lit(AS_OF)) - F.expr("INTERVAL 2 MINUTES")).otherwise(none).alias("claimed_at"), F.when(F.col("event_id") % 5 == 0, F.col("ts").cast("timestamp")).otherwise(none).alias("published_at"), (F.col("event_id") % 30).alias("attempts"))


@register(f"SELECT event_id, event_id % 30 + 1 AS attempts FROM events WHERE event_id % 5 <> 0 AND event_id % 4 <> 0 AND ts <= TIMESTAMP '{AS_OF}' ORDER BY ts, event_id LIMIT 50", cards=False)
def outbox_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outbox.claim(_outbox(spark, sf_dir), AS_OF).select("event_id", "attempts")


@register("SELECT event_id, least((event_id % 30) * (event_id % 30), 300) AS wait FROM events", cards=False)
def outbox_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outbox(spark, sf_dir).select("event_id", backoff_seconds(F.col("attempts")).alias("wait"))


@register("SELECT min(event_id) AS event_id, user_id, event_type FROM events GROUP BY user_id, event_type", cards=False)
def outbox_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event an idempotency key, the first."""
    return outbox.idempotent(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), ["user_id", "event_type"], "event_id")


@register("SELECT date_trunc('hour', ts)::VARCHAR AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL", cards=False)
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("at", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type", "n", "total")

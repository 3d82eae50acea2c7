"""Import runs over the documents, in memory and stored."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import imports
from ..operators.releases import ReleaseStore
from ..sources.cards import cards, table
from ..sources.scratch import Scratch, shared_dir
from .registry import register

LEAST = 10


def sources(spark: SparkSession, sf_dir: str, scratch: Scratch) -> DataFrame:
    """What imports take of the documents, made once: no run reads a text again."""
    return scratch.write(cards(spark, sf_dir, "doc_id", "stable_key", "prompt", "short_answer", "content_hash"))


def incoming(sources: DataFrame, which: str, changed: bool = False) -> DataFrame:
    """The cards of the sources that ``which`` holds for; every seventh differs where ``changed``. Short prompts are a problem."""
    c = sources.filter(which)
    if changed:
        c = c.withColumn("content_hash", F.when(F.col("doc_id") % 7 == 0, F.concat("content_hash", F.lit("x"))).otherwise(F.col("content_hash")))
    problems = F.when(F.length("prompt") < LEAST, F.array(F.lit("short_prompt"))).otherwise(F.array().cast("array<string>"))
    none = F.struct(F.lit(None).cast("string").alias("prompt"), F.lit(None).cast("string").alias("short_answer"), F.lit(None).cast("string").alias("explanation"))
    return c.select(F.concat("stable_key", F.lit(".md")).alias("source_ref"), "stable_key", "content_hash", problems.alias("problems"), F.struct("prompt", "short_answer", F.lit(None).cast("string").alias("explanation")).alias("en"), none.alias("ru"))


@register(
    f""", v AS (SELECT doc_id, stable_key, doc_id % 5 <> 0 AS i1, doc_id % 3 <> 0 AS i2, doc_id % 4 <> 0 AS i3, doc_id % 7 = 0 AS ch FROM cards WHERE length(prompt) >= {LEAST} AND (doc_id % 5 <> 0 OR doc_id % 3 <> 0 OR doc_id % 4 <> 0)),
    a AS (SELECT *, CASE WHEN i2 AND i1 AND ch THEN 2 ELSE 1 END AS r2, i2 AS p2, i1 OR i2 AS e2, CASE WHEN NOT i1 AND i2 AND ch THEN 2 ELSE 1 END AS base FROM v),
    b AS (SELECT *, CASE WHEN NOT i3 THEN 'kept' WHEN NOT e2 THEN 'created' WHEN base <> r2 THEN 'updated' WHEN NOT p2 THEN 'published' ELSE 'unchanged' END AS action FROM a)
    SELECT stable_key, CASE WHEN NOT i3 AND p2 THEN 'archived' WHEN i3 OR p2 THEN 'published' ELSE 'draft' END AS status, CASE WHEN i3 AND e2 THEN base WHEN i3 THEN 1 ELSE r2 END AS revision_no, action,
      (i1::INT + CASE WHEN NOT i2 THEN 0 ELSE 1 END + CASE WHEN NOT i3 OR action = 'unchanged' OR (action = 'updated' AND base = 1 AND i1 AND i2 AND NOT ch) THEN 0 ELSE 1 END)::BIGINT AS events FROM b /* FROM cards */"""
)
def import_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs on each other's tables: drafts, published with changes, published without them; what becomes of each question, and its outbox events."""
    scratch = Scratch(spark, "import_runs")
    docs = sources(spark, sf_dir, scratch)
    settled = lambda done: {**done.tables, **scratch.write_all({n: done.tables[n] for n in ("questions", "revisions", "outbox")})}
    one = settled(imports.drafts(imports.empty(spark), incoming(docs, "doc_id % 5 <> 0"), scratch.write))
    two = settled(imports.published(one, incoming(docs, "doc_id % 3 <> 0", changed=True), scratch.write))
    three = imports.published(two, incoming(docs, "doc_id % 4 <> 0"), scratch.write)
    events = three.tables["outbox"].groupBy("stable_key").agg(F.count(F.lit(1)).alias("events"))
    return three.tables["questions"].join(three.written.select("stable_key", "action"), "stable_key").join(events, "stable_key", "left").select("stable_key", "status", "revision_no", "action", F.coalesce("events", F.lit(0)).alias("events"))


@register(cards=False)
def import_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same runs stored, each a release of its own, and the second rolled back to the first; what each version of the log shows: questions by status."""
    scratch = Scratch(spark, "import_releases")
    docs = sources(spark, sf_dir, scratch)
    store = ReleaseStore(spark, f"{shared_dir(spark)}/imports-{uuid.uuid4().hex[:12]}", "main")
    imports.commit(store, imports.drafts(imports.stored(store), incoming(docs, "doc_id % 5 <> 0"), scratch.write), "run-1", "importer", "t1")
    imports.commit(store, imports.published(imports.stored(store), incoming(docs, "doc_id % 3 <> 0", changed=True), scratch.write), "run-2", "importer", "t2")
    store.roll_back("editor", "t3")
    imports.commit(store, imports.published(imports.stored(store), incoming(docs, "doc_id % 4 <> 0"), scratch.write), "run-3", "importer", "t4")
    out = None
    for e in store.history():
        own = store.read("questions", version=e.version).groupBy("status").agg(F.count(F.lit(1)).alias("n")).select(F.lit(e.version).alias("version"), F.lit(e.release_id).alias("release_id"), "status", "n")
        out = own if out is None else out.union(own)
    return out


@register(
    r"""WITH l AS (SELECT sale_id, line_no, count(*) AS n FROM sale_lines GROUP BY ALL),
    s AS (SELECT sale_id, count(*) AS lines, min(line_no) AS lo, max(line_no) AS hi, bool_or(n > 1) AS twice FROM l WHERE line_no IS NOT NULL GROUP BY sale_id)
    SELECT 'sequence' AS guard, sale_id::VARCHAR AS row_id, CASE WHEN twice THEN 'line_twice' WHEN lo <> 1 OR hi <> lines THEN 'gap' END AS code FROM s WHERE twice OR lo <> 1 OR hi <> lines
    UNION ALL SELECT 'line', sale_id || '.' || line_no, CASE WHEN sale_id NOT IN (SELECT sale_id FROM sales WHERE sale_id IS NOT NULL) THEN 'sale_missing' WHEN item_id IS NULL OR item_id NOT IN (SELECT item_id FROM items WHERE item_id IS NOT NULL) THEN 'item_missing' WHEN vendor_id IS NULL OR vendor_id NOT IN (SELECT vendor_id FROM vendors WHERE vendor_id IS NOT NULL) THEN 'vendor_missing' END AS c
      FROM sale_lines WHERE sale_id IS NOT NULL AND line_no IS NOT NULL AND c IS NOT NULL
    UNION ALL SELECT 'sale', sale_id::VARCHAR, CASE WHEN client_id IS NULL OR client_id NOT IN (SELECT client_id FROM clients WHERE client_id IS NOT NULL) THEN 'client_missing' WHEN total < 0 THEN 'total' END AS c FROM sales WHERE c IS NOT NULL""",
    cards=False,
)
def bundle_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bundle of tables checked for its references at once, and the order of its parts: the lines of a sale are numbered from 1 without gap or repeat."""
    from ..operators.constraints import Reference, Rules, violations

    t = {n: table(spark, sf_dir, n) for n in ("sales", "sale_lines", "items", "vendors", "clients")}
    t["lines"] = t["sale_lines"].filter("sale_id IS NOT NULL AND line_no IS NOT NULL").withColumn("id", F.concat_ws(".", F.col("sale_id").cast("string"), F.col("line_no").cast("string")))
    per = t["sale_lines"].filter("line_no IS NOT NULL").groupBy("sale_id", "line_no").agg(F.count(F.lit(1)).alias("n"))
    t["sequences"] = per.groupBy("sale_id").agg(F.count(F.lit(1)).alias("lines"), F.min("line_no").alias("lo"), F.max("line_no").alias("hi"), F.bool_or(F.col("n") > 1).alias("twice"))
    rules = [
        Rules("sequences", "sale_id", guards={"sequence": [("line_twice", "twice"), ("gap", "lo <> 1 OR hi <> lines")]}),
        Rules(
            "lines",
            "id",
            (Reference(("sale_id",), "sales", ("sale_id",), {"sale": "sale_id"}), Reference(("item_id",), "items", ("item_id",), {"item": "item_id"}), Reference(("vendor_id",), "vendors", ("vendor_id",), {"vendor": "vendor_id"})),
            {"line": [("sale_missing", "sale IS NULL"), ("item_missing", "item IS NULL"), ("vendor_missing", "vendor IS NULL")]},
        ),
        Rules("sales", "sale_id", (Reference(("client_id",), "clients", ("client_id",), {"client": "client_id"}),), {"sale": [("client_missing", "client IS NULL"), ("total", "total < 0")]}),
    ]
    return violations(rules, t).select("guard", "row_id", "code")

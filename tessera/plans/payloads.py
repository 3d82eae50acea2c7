"""JSON payloads of any shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import variants
from ..sources.cards import table
from .registry import register

_CENSUS = r"""SELECT source, regexp_replace(fullkey, '\[\d+\]', '[]', 'g') AS path,
    CASE type WHEN 'VARCHAR' THEN 'string' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END AS type,
    count(*) AS n, count(DISTINCT id) AS rows, min(CASE WHEN type = 'VARCHAR' THEN atom ->> '$' END) AS least_text
    FROM (SELECT 'clicks' AS source, row_number() OVER () AS id, props FROM clicks WHERE json_valid(props) UNION ALL SELECT 'events', row_number() OVER (), props FROM events WHERE json_valid(props)) x, json_tree(x.props) t
    GROUP BY ALL"""


def first_of_kind(values: Column) -> Column:
    """Sorted values with ``first``: whether none of their path and type precedes."""
    kind = lambda x: F.struct(x["path"], x["type"])
    return F.transform(values, lambda x, i: F.struct(x["path"].alias("path"), x["type"].alias("type"), x["text"].alias("text"), ((i == 0) | (kind(F.get(values, i - 1)) != kind(x))).alias("first")))


@register(_CENSUS.replace("count(DISTINCT id)", "count(DISTINCT x.id)"), cards=False)
def json_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which paths and types the props of clicks and events hold: values, rows that hold one, and the least string."""
    out = None
    for name in ("clicks", "events"):
        # in a row sorted by path and type the first of each tells that the row holds one, so that values are counted where they are found and no row is gathered
        own = table(spark, sf_dir, name).groupBy("props").agg(F.count(F.lit(1)).alias("times"))  # equal texts are walked once
        own = own.select(F.lit(name).alias("source"), "times", F.array_sort(variants.walk(F.col("props"))).alias("x"))
        own = own.select("source", "times", F.explode(variants.let(F.col("x"), first_of_kind)).alias("x"))
        out = own if out is None else out.union(own)
    text = F.when(F.col("x.type") == "string", F.col("x.text"))
    return out.groupBy("source", "x.path", "x.type").agg(F.sum("times").alias("n"), F.sum(F.when(F.col("x.first"), F.col("times")).otherwise(0)).alias("rows"), F.min(text).alias("least_text"))

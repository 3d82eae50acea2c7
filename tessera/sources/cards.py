"""Adapter views: the engine's concepts derived from the driver's tables, and sections of HTML pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import slugify


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Columns of cards() that need the labels.
LABELLED = ("level", "content_kind")


def cards(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    """Current questions: prompt, short answer and explanation are the lines of a document; level and kind come from its labels.

    cols: the columns wanted, all if none is named. Lines are cut before anything is joined, and labels only joined where they are asked for, so that no query shuffles texts.
    """
    # only the first n lines are split
    line = lambda n: F.split_part(F.substring_index("text", "\n", n), F.lit("\n"), F.lit(n))
    own = {
        "doc_id": F.col("doc_id"),
        "stable_key": F.concat(F.lit("question.d"), "doc_id"),
        "slug": F.concat(F.lit("d"), "doc_id"),
        "locale": F.col("lang"),
        "prompt": line(1),
        "short_answer": F.nullif(line(2), F.lit("")),
        "topic": F.concat(F.lit("topic."), slugify(F.col("source"))),
        "content_hash": F.sha2("text", 256),
        "text": F.col("text"),
    }
    cols = cols or (*own, *LABELLED)
    out = table(spark, sf_dir, "documents").select(*[v.alias(k) for k, v in own.items() if k in cols or k == "doc_id"])
    if set(cols) & set(LABELLED):
        level = F.when(F.col("quality").isNotNull(), F.concat(F.lit("q"), "quality")).alias("level")
        kind = F.when(F.col("toxic") == 1, "fixture").otherwise("production").alias("content_kind")
        out = out.join(table(spark, sf_dir, "labels"), "doc_id", "left").select(*out.columns, level, kind)
    return out.select(*cols)


def html_sections(pages: DataFrame) -> DataFrame:
    """page_id, title, n_links, plain: markup stripped from a page's body."""
    body = F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    plain = F.trim(F.regexp_replace(F.regexp_replace(body, r"<[^>]*>", " "), r"[ \t\n\r]+", " "))
    return pages.select("page_id", F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1).alias("title"), F.regexp_count("html", F.lit(r"<a ")).alias("n_links"), plain.alias("plain"))


ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def unescaped(c: F.Column) -> F.Column:
    for name, letter in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(letter))
    return c


def html_text(html: F.Column) -> F.Column:
    """A page's body as text: <pre> becomes a fence, headings lines of their own, other markup goes, entities are letters."""
    body = F.regexp_extract(F.concat(html, F.lit("</body>")), r"(?is)(?:<body[^>]*>|^(?!.*<body))(.*?)</body>", 1)
    out = F.regexp_replace(body, r"(?is)<(script|style)[^>]*>.*?</\1>", "")
    out = F.regexp_replace(F.regexp_replace(out, r"(?i)<pre[^>]*>", "\n```\n"), "(?i)</pre>", "\n```\n")
    out = F.regexp_replace(F.regexp_replace(out, r"(?i)<h[1-6][^>]*>", "\n## "), r"(?i)</(h[1-6]|p|div|li|tr)>|<br[^>]*>", "\n")
    return F.trim(F.regexp_replace(unescaped(F.regexp_replace(out, "<[^>]*>", "")), "\n{3,}", "\n\n"))


def html_headed(html: F.Column) -> F.Column:
    """array<struct<title, body>> of a page's headings."""
    parts = F.split(F.concat(F.lit("\n"), html_text(html)), r"\n## ")
    cut = lambda x: F.struct(F.trim(F.split_part(x, F.lit("\n"), F.lit(1))).alias("title"), F.trim(F.substr(x, F.length(F.split_part(x, F.lit("\n"), F.lit(1))) + 1)).alias("body"))
    return F.transform(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), cut)

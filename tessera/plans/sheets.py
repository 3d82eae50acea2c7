"""Task extraction over the lines of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import sheets
from ..sources.cards import table
from .registry import register

#: Marks that the prose of the documents holds: a line of two words opens a task, one of one word another kind; a line that begins with a capital O tells the section, and one of three words the answer of its first.
STANDIN = sheets.TaskSheet((("pair", r"^(\S+) (\S+)$"), ("single", r"^(\S+)$")), (("pair", (("grades", 1), ("minutes", 2), ("used", 1))), ("single", (("used", 1),))), r"^(O\S*) ", "Enststung ench.")


@register(
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
    c AS (SELECT *, trim(regexp_replace(raw, '[\s\x0B\x{85}\x{A0}]+', ' ', 'g')) AS x FROM l),
    k AS (SELECT *, CASE WHEN regexp_matches(x, '^\S+ \S+$') THEN 'pair' WHEN regexp_matches(x, '^\S+$') THEN 'single' END AS kind, nullif(regexp_extract(raw, '^(O\S*) ', 1), '') AS section FROM c),
    g AS (SELECT *, count(kind) OVER (PARTITION BY doc_id ORDER BY i) AS g, last_value(section IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 13 PRECEDING AND 1 PRECEDING) AS above FROM k),
    b AS (SELECT doc_id, g, i, kind, above, count(*) FILTER (WHERE kind IS NULL) OVER w AS n_body, min(CASE WHEN kind IS NULL AND x = 'Enststung ench.' THEN i END) OVER w AS answer, max(i) OVER w AS last FROM g WINDOW w AS (PARTITION BY doc_id, g))
    SELECT doc_id, i::INT AS line, kind, above AS section, n_body, CASE WHEN answer IS NOT NULL THEN last - answer ELSE 0 END AS n_answer FROM b WHERE kind IS NOT NULL""",
    cards=False,
)
def text_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks of every document by the stand-in's marks: where they begin, kind and section, lines of the body and of what follows the answer's line."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    counts = lambda body, cut: {"n_body": F.size(body).cast("long"), "n_answer": F.greatest(F.size(body) - cut - 1, F.lit(0)).cast("long")}
    own = d.select("doc_id", F.explode(sheets.tasks(F.col("text"), STANDIN, counts)).alias("t"))
    return own.select("doc_id", *[F.col(f"t.{c}").alias(c) for c in ("line", "kind", "section", "n_body", "n_answer")])

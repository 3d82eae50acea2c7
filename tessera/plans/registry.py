"""All registered queries and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The adapter view of sources/cards.py.
CARDS = r"""cards AS (
  SELECT d.doc_id, 'question.d' || d.doc_id AS stable_key, 'd' || d.doc_id AS slug, d.lang AS locale,
         split_part(d.text, chr(10), 1) AS prompt, nullif(split_part(d.text, chr(10), 2), '') AS short_answer,
         'topic.' || lower(d.source) AS topic, CASE WHEN l.quality IS NOT NULL THEN 'q' || l.quality END AS level,
         CASE WHEN l.toxic = 1 THEN 'fixture' ELSE 'production' END AS content_kind, sha256(d.text) AS content_hash, d.text
  FROM documents d LEFT JOIN labels l USING (doc_id))"""


def register(oracle: str | None = None, cards: bool = True):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = f"WITH {CARDS} {oracle}" if cards and "FROM cards" in oracle or cards and "JOIN cards" in oracle else oracle
        return f

    return add

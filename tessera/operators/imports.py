"""An import as one run: gates, writes to all tables, archiving and the run's report, as functions of the tables before it.

Tables (``TABLES``): questions (stable_key, status, revision_no), revisions (stable_key, revision_no, content_hash), locales (stable_key, locale, prompt, short_answer), outbox and audit
(stable_key, event_type, idempotency_key). Cards: source_ref, stable_key, content_hash, problems array<string>, en and ru structs (prompt, short_answer, explanation).

Nothing is changed in place: a run gives new tables, which a release store publishes together, so that a reader sees all of a run or nothing of it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import state
from .releases import Entry, ReleaseStore

TABLES = {
    "questions": "stable_key string, status string, revision_no int",
    "revisions": "stable_key string, revision_no int, content_hash string",
    "locales": "stable_key string, locale string, prompt string, short_answer string",
    "outbox": "stable_key string, event_type string, idempotency_key string",
    "audit": "stable_key string, event_type string, idempotency_key string",
}
DUPLICATE = "duplicate_key"
Settled = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Run:
    tables: dict[str, DataFrame]
    items: DataFrame  # source_ref, stable_key, action, problems
    written: DataFrame  # stable_key, status, revision_no, action: of all questions

    def report(self, run_id: str) -> DataFrame:
        """One row: run_id, totals by action, files, invalid."""
        totals = state.run_report(self.items, run_id)
        return totals.join(self.items.agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("action") == "invalid").alias("invalid")))  # rows of one


def empty(spark: SparkSession) -> dict[str, DataFrame]:
    return {n: spark.createDataFrame([], s) for n, s in TABLES.items()}


def gated(cards: DataFrame, settled: Settled = lambda df: df) -> DataFrame:
    """cards with their problems and, of cards that share a stable_key, that of all but the first source_ref. The first is told by a minimum, so that a key of many files is no group of rows.
    Only keys of more than one card are joined back: where they are few and ``settled``, Spark sends them to the cards, whose texts stay where they are."""
    sound = F.size("problems") == 0
    several = cards.filter(sound).groupBy("stable_key").agg(F.min("source_ref").alias("__first"), F.count(F.lit(1)).alias("n"))
    j = cards.join(settled(several.filter("n > 1").select("stable_key", "__first")), "stable_key", "left")
    again = sound & (F.col("source_ref") != F.col("__first"))
    return j.withColumn("problems", F.when(again, F.array(F.lit(DUPLICATE))).otherwise(F.col("problems"))).select(*cards.columns)


def run(tables: dict[str, DataFrame], cards: DataFrame, publish: bool, archive: bool = False, settled: Settled = lambda df: df) -> Run:
    """Cards without problems are written, as drafts or published; with ``archive`` published questions without a card in this run are archived. A source whose card has problems neither writes nor keeps its question from being archived.

    ``settled(df)`` ends a lineage by writing a table: all tables of a run come from the cards, what was written of them and their revisions, which are then made once and not again for each table. The cards
    themselves are read for each table, of the columns that it needs: they should be stored ones.
    """
    cards = gated(cards, settled)
    sound = cards.filter(F.size("problems") == 0)
    written, revisions = state.write_cards(tables["questions"], tables["revisions"], sound.select("stable_key", "content_hash", F.lit(publish).alias("publish")), settled)
    written = settled(written)
    questions = written.select("stable_key", "status", "revision_no")
    if archive:
        questions = state.archive_missing(questions, sound, "stable_key").select("stable_key", "status", "revision_no")
    events = state.emitted(written)
    locales = state.upsert_locales(tables["locales"], state.locales_of(sound).select("stable_key", "locale", "prompt", "short_answer"))
    new = {
        "questions": questions,
        "revisions": revisions.select("stable_key", F.col("revision_no").cast("int").alias("revision_no"), "content_hash"),
        "locales": locales.drop("action"),
        "outbox": state.insert_or_ignore(tables["outbox"], events, "idempotency_key"),
        "audit": state.insert_or_ignore(tables["audit"], events, "idempotency_key"),
    }
    action = F.when(F.size("problems") > 0, "invalid").otherwise(F.col("action"))
    items = cards.select("source_ref", "stable_key", "problems").join(written.select("stable_key", "action"), "stable_key", "left").select("source_ref", "stable_key", action.alias("action"), "problems")
    return Run(new, items, written.select("stable_key", "status", "revision_no", "action"))


def drafts(tables: dict[str, DataFrame], cards: DataFrame, settled: Settled = lambda df: df) -> Run:
    """Entry point: cards as drafts; what is published stays so."""
    return run(tables, cards, publish=False, settled=settled)


def published(tables: dict[str, DataFrame], cards: DataFrame, settled: Settled = lambda df: df) -> Run:
    """Entry point: cards published at once; questions that have no card any more are archived."""
    return run(tables, cards, publish=True, archive=True, settled=settled)


def staged(tables: dict[str, DataFrame], cards: DataFrame, stages: DataFrame, settled: Settled = lambda df: df) -> Run:
    """Entry point: cards published if their review stage (stable_key, content_hash, status) allows it: it is cleared or published, or the card is the current one unchanged. Others have the problem ``not_cleared``."""
    from .review import publishable

    now = tables["questions"].join(tables["revisions"], ["stable_key", "revision_no"]).select("stable_key", "content_hash")
    ready = publishable(stages.select("stable_key", "content_hash", "status"), now).filter("ready").select("stable_key", "content_hash", F.lit(True).alias("__ready")).distinct()
    j = cards.join(ready, ["stable_key", "content_hash"], "left")
    held = F.when(F.col("__ready"), F.col("problems")).otherwise(F.array_append("problems", F.lit("not_cleared")))
    return run(tables, j.withColumn("problems", held).select(*cards.columns), publish=True, settled=settled)


def stored(store: ReleaseStore, tables: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """The tables of the active release, or empty ones."""
    return {n: store.read(n) for n in TABLES} if store.head() else tables or empty(store.spark)


def commit(store: ReleaseStore, done: Run, run_id: str, actor: str, at: str, expected: int | None = None) -> Entry:
    """Publish a run's tables, with its items, as one release named after it: all of them or none, and a conflict if another run was first."""
    return store.publish(run_id, {**done.tables, "items": done.items}, actor, at, expected)

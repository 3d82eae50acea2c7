"""Mutations as pure functions (state, change) -> state over immutable tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import blank, degenerate

Guard = Callable[[Column, Column], Column]


def _keys(key: str | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else key


def upsert(state: DataFrame, change: DataFrame, key: str | list[str], guard: dict[str, Guard] | None = None) -> DataFrame:
    """state with ``change`` laid over it by key, and ``action``: created, updated, unchanged or kept. Both have the same columns.
    guard: for a column, a function (old, new) that tells whether the new value may replace the old. A row whose guards keep all old values is unchanged."""
    key = _keys(key)
    cols = [c for c in state.columns if c not in key]
    s = state.select(*key, F.struct(*cols).alias("s"))
    c = change.select(*key, F.struct(*cols).alias("c"))
    both = s.join(c, key, "full_outer")

    def value(n: str) -> Column:
        old, new = F.col(f"s.{n}"), F.col(f"c.{n}")
        kept = F.col("s").isNotNull() & ~F.coalesce(guard[n](old, new), F.lit(False)) if guard and n in guard else F.lit(False)
        return F.when(F.col("c").isNull() | kept, old).otherwise(new)

    both = both.withColumn("v", F.struct(*[value(n).alias(n) for n in cols]))
    action = F.when(F.col("s").isNull(), "created").when(F.col("c").isNull(), "kept").when(F.col("s").eqNullSafe(F.col("v")), "unchanged").otherwise("updated")
    return both.select(*key, *[F.col(f"v.{n}").alias(n) for n in cols], action.alias("action"))


def insert_or_ignore(state: DataFrame, change: DataFrame, key: str | list[str]) -> DataFrame:
    """Rows of ``change`` whose key is not there are added, once each; those that are stay as they are."""
    return state.unionByName(change.dropDuplicates(_keys(key)).join(state, _keys(key), "left_anti").select(*state.columns))


def delete(state: DataFrame, keys: DataFrame, key: str | list[str]) -> DataFrame:
    return state.join(keys, _keys(key), "left_anti")


def archive_missing(state: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """Published rows whose source is gone become archived."""
    gone = state.join(sources.select(key).distinct(), key, "left_anti").filter("status = 'published'").select(key, F.lit(True).alias("gone"))
    return state.join(gone, key, "left").withColumn("status", F.when(F.col("gone"), "archived").otherwise(F.col("status"))).drop("gone")


def decide(current: DataFrame, wanted: DataFrame, key: str, open_: str = "open") -> DataFrame:
    """Compare-and-set of review decisions: the same again is a no-op, another one a conflict."""
    both = wanted.select(key, F.col("decision").alias("wanted")).join(current.select(key, "decision"), key, "left")
    result = F.when(F.col("decision").isNull(), "missing").when(F.col("decision") == open_, "ok").when(F.col("decision") == F.col("wanted"), "noop").otherwise("conflict")
    return both.select(key, result.alias("result"), F.when(F.col("decision") == open_, F.col("wanted")).otherwise(F.col("decision")).alias("decision"))


def revoke(current: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Accepted becomes rejected; again, or of one that is rejected, it is a no-op, of an open one a conflict. key, result, decision."""
    both = keys.select(key).distinct().join(current.select(key, "decision"), key, "left")
    d = F.col("decision")
    result = F.when(d.isNull(), "missing").when(d == "accepted", "ok").when(d == "rejected", "noop").otherwise("conflict")
    return both.select(key, result.alias("result"), F.when(d == "accepted", "rejected").otherwise(d).alias("decision"))


def reconcile(manifest: DataFrame, current: DataFrame, key: str, pin: str) -> DataFrame:
    """For each key of either side: covered, stale, missing (not in the manifest) or extra."""
    both = manifest.select(key, F.col(pin).alias("a")).join(current.select(key, F.col(pin).alias("b")), key, "full_outer")
    return both.select(key, F.when(F.col("a").isNull(), "missing").when(F.col("b").isNull(), "extra").when(F.col("a") == F.col("b"), "covered").otherwise("stale").alias("state"))


def new_revisions(revisions: DataFrame, cards: DataFrame) -> DataFrame:
    """revisions (stable_key, revision_no, content_hash) and those that cards (stable_key, content_hash, one a key) add: a hash that the key has had keeps its number. ``fresh`` tells the added."""
    last = revisions.groupBy("stable_key").agg(F.max("revision_no").alias("last"))
    add = cards.select("stable_key", "content_hash").dropDuplicates(["stable_key"]).join(revisions, ["stable_key", "content_hash"], "left_anti").join(last, "stable_key", "left")
    add = add.select("stable_key", (F.coalesce("last", F.lit(0)) + 1).alias("revision_no"), "content_hash", F.lit(True).alias("fresh"))
    return revisions.select("stable_key", F.col("revision_no"), "content_hash", F.lit(False).alias("fresh")).unionByName(add)


def write_cards(questions: DataFrame, revisions: DataFrame, cards: DataFrame, settled: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame]:
    """(questions, new revisions as above) after cards are written. questions: stable_key, status, revision_no; cards: stable_key, content_hash, publish.

    A card is created, updated (a new revision), published (a draft, with the revision that it has) or unchanged; a draft import never takes a published card back. ``settled`` may end the lineage of the revisions.
    """
    all_ = settled(new_revisions(revisions, cards))
    c = cards.dropDuplicates(["stable_key"]).join(all_.withColumnRenamed("revision_no", "no"), ["stable_key", "content_hash"])
    both = questions.join(c.select("stable_key", "no", "fresh", "publish"), "stable_key", "full_outer")
    was, now = F.col("status") == "published", F.coalesce("publish", F.lit(False))
    status = F.when(F.col("publish").isNull(), F.col("status")).when(F.coalesce(was, F.lit(False)) | now, "published").otherwise("draft")
    moved = F.col("fresh") | (F.col("no") != F.col("revision_no"))
    action = F.when(F.col("publish").isNull(), "kept").when(F.col("status").isNull(), "created").when(moved, "updated").when(now & ~was, "published").otherwise("unchanged")
    return both.select("stable_key", status.alias("status"), F.coalesce("no", "revision_no").alias("revision_no"), action.alias("action")), all_


def emitted(written: DataFrame) -> DataFrame:
    """Audit and outbox rows of write_cards: only of cards that were created, updated or published, named by status and revision so that a repeat is told. The event follows the status."""
    done = written.filter(F.col("action").isin("created", "updated", "published"))
    event = F.concat(F.lit("question.revision."), F.when(F.col("status") == "published", "published").otherwise("drafted"))
    return done.select("stable_key", event.alias("event_type"), F.concat_ws(":", event, "stable_key", F.col("revision_no").cast("string")).alias("idempotency_key"))


def rolled_back(questions: DataFrame, revisions: DataFrame, targets: DataFrame) -> DataFrame:
    """stable_key, revision_no, result of moving the current revision to a number (targets: stable_key, to_no) that the card has: ok, noop or missing."""
    have = revisions.select("stable_key", F.col("revision_no").alias("to_no"), F.lit(True).alias("have"))
    both = targets.join(have, ["stable_key", "to_no"], "left").join(questions.select("stable_key", "revision_no"), "stable_key", "left")
    result = F.when(F.col("have").isNull() | F.col("revision_no").isNull(), "missing").when(F.col("to_no") == F.col("revision_no"), "noop").otherwise("ok")
    return both.select("stable_key", F.when(result == "ok", F.col("to_no")).otherwise(F.col("revision_no")).alias("revision_no"), result.alias("result"))


def locales_of(cards: DataFrame) -> DataFrame:
    """stable_key, locale, prompt, short_answer, explanation: English of every card, Russian where one of its fields is given. cards: en and ru structs of the three."""
    one = lambda n: F.struct(F.lit(n).alias("locale"), F.col(f"{n}.prompt"), F.col(f"{n}.short_answer"), F.col(f"{n}.explanation"))
    some = ~blank(F.col("ru.prompt")) | ~blank(F.col("ru.short_answer")) | ~blank(F.col("ru.explanation"))
    return cards.select("stable_key", F.inline(F.when(some, F.array(one("en"), one("ru"))).otherwise(F.array(one("en")))))


def upsert_locales(state: DataFrame, change: DataFrame) -> DataFrame:
    """Both: stable_key, locale, prompt, short_answer. A degenerate Russian prompt never takes the place of another that is not blank."""
    own = ["stable_key", "locale"]
    s, c = state.select(*own, F.struct("prompt", "short_answer").alias("s")), change.select(*own, F.struct("prompt", "short_answer").alias("c"))
    both = s.join(c, own, "full_outer")
    poor = (F.col("locale") == "ru") & degenerate(F.col("c.prompt"), F.col("c.short_answer")) & ~blank(F.col("s.prompt")) & (F.col("s.prompt") != F.coalesce("c.prompt", F.lit("")))
    v = F.when(F.col("c").isNull(), F.col("s")).when(F.col("s").isNotNull() & poor, F.struct(F.col("s.prompt"), F.col("c.short_answer"))).otherwise(F.col("c"))
    action = F.when(F.col("s").isNull(), "created").when(F.col("c").isNull(), "kept").when(v.eqNullSafe(F.col("s")), "unchanged").otherwise("updated")
    return both.select(*own, v["prompt"].alias("prompt"), v["short_answer"].alias("short_answer"), action.alias("action"))


def repair(state: DataFrame, values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(state with the prompts of ``values`` (stable_key, locale, new_prompt) where the locale is degenerate, one row with the number repaired and of those still degenerate)."""
    both = state.join(values, ["stable_key", "locale"], "left")
    may = degenerate(F.col("prompt"), F.col("short_answer")) & ~blank(F.col("new_prompt"))
    out = both.withColumn("repaired", F.coalesce(may, F.lit(False))).withColumn("prompt", F.when(F.col("repaired"), F.col("new_prompt")).otherwise(F.col("prompt")))
    count = out.agg(F.count_if("repaired").alias("repaired"), F.count_if(degenerate(F.col("prompt"), F.col("short_answer"))).alias("residual"))
    return out.select(*state.columns), count


def alias_proposals(state: DataFrame, change: DataFrame, active: DataFrame) -> DataFrame:
    """change: action, alias_key, canonical_key, provenance (JSON) with ``problem``, and ``result`` created or existing for sound ones. state: action, alias_key, canonical_key; active: key."""
    known = active.select(F.col("key").alias("canonical_key"), F.lit(True).alias("active")).distinct()
    old = state.select("action", "alias_key", "canonical_key", F.lit(True).alias("there")).distinct()
    c = change.join(known, "canonical_key", "left").join(old, ["action", "alias_key", "canonical_key"], "left")
    problem = (
        F.when(~F.coalesce(F.col("action").isin("alias", "supersedes"), F.lit(False)), "action")
        .when(blank(F.col("alias_key")) | blank(F.col("canonical_key")) | (F.col("alias_key") == F.col("canonical_key")), "keys")
        .when(~F.coalesce(F.col("provenance").rlike(r"(?s)^\s*\{.*\}\s*$") & F.json_object_keys("provenance").isNotNull(), F.lit(False)), "provenance")
        .when(F.col("active").isNull(), "inactive_canonical")
    )
    return c.select(*change.columns, problem.alias("problem"), F.when(problem.isNull(), F.when(F.col("there"), "existing").otherwise("created")).alias("result"))


def materialised(aliases: DataFrame, accepted: DataFrame) -> DataFrame:
    """Accepted alias or supersession rows (alias_key, canonical_key) against the table of them: added, there, or conflict where the key stands for another."""
    old = aliases.select("alias_key", F.col("canonical_key").alias("now"))
    j = accepted.join(old, "alias_key", "left")
    return j.select("alias_key", "canonical_key", F.when(F.col("now").isNull(), "added").when(F.col("now") == F.col("canonical_key"), "there").otherwise("conflict").alias("result"))


def released(releases: DataFrame, release_id: str, at: str) -> DataFrame:
    """releases (workspace, release_id, status, created_at) with release_id as the active one of its workspace: the one before becomes superseded. One that is active stays
    as it is; one that was rolled back may not come again."""
    w = Window.partitionBy("workspace")
    own = F.col("release_id") == release_id
    bad = F.max(F.when(own & (F.col("status") == "rolled_back"), True)).over(w)
    status = F.when(bad, F.raise_error(F.lit(f"{release_id} was rolled back"))).when(own, "active").when((F.col("status") == "active") & (F.max(own).over(w)), "superseded").otherwise(F.col("status"))
    return releases.withColumn("created_at", F.when(own & (F.col("status") != "active"), F.to_timestamp(F.lit(at))).otherwise(F.col("created_at"))).withColumn("status", status.cast("string"))


def roll_back(releases: DataFrame, workspace: str) -> DataFrame:
    """The active release of a workspace is rolled back, and the one superseded last is active again; what it projects is its own stored rows."""
    own = F.col("workspace") == workspace
    last = F.max(F.when(own & (F.col("status") == "superseded"), F.struct("created_at", "release_id"))).over(Window.partitionBy("workspace"))
    back = releases.withColumn("last", last)
    some = own & F.col("last").isNotNull()
    status = F.when(some & (F.col("status") == "active"), "rolled_back").when(some & (F.col("release_id") == F.col("last.release_id")), "active").otherwise(F.col("status"))
    return back.withColumn("status", status).drop("last")


def active_twice(releases: DataFrame) -> DataFrame:
    """Workspaces that break the rule of one active release."""
    return releases.filter("status = 'active'").groupBy("workspace").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def placements(cards: DataFrame, proposals: DataFrame) -> DataFrame:
    """Topics that a placement release gives its cards: the earliest sound proposal of each, accepted with it. proposals: stable_key, topic_key, decision, created_at, id."""
    sound = proposals.filter(F.col("decision").isin("proposed", "accepted")).join(cards.select("stable_key"), "stable_key", "left_semi")
    one = sound.groupBy("stable_key").agg(F.min_by(F.struct("topic_key", "id"), F.struct("created_at", "id")).alias("p"))
    return one.select("stable_key", "p.topic_key", "p.id", F.lit("accepted").alias("decision"))


def refresh_proposals(state: DataFrame, change: DataFrame, key: list[str]) -> DataFrame:
    """Evidence and score of proposals that are still open follow the change; decided ones stay. Both: key, confidence, status."""
    new = change.select(*key, F.col("confidence").alias("new"))
    both = state.join(new, key, "full_outer")
    conf = F.when(F.col("new").isNotNull() & F.coalesce(F.col("status") == "proposed", F.lit(True)), F.col("new")).otherwise(F.col("confidence"))
    return both.select(*key, conf.alias("confidence"), F.coalesce("status", F.lit("proposed")).alias("status"))


def binding_projection(releases: DataFrame, items: DataFrame) -> DataFrame:
    """What is bound now: the items of the active releases."""
    return items.join(releases.filter("status = 'active'").select("release_id"), "release_id", "left_semi")


def separated_domains(mappings: DataFrame, rules: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(mappings whose path asks for a domain of its own in that domain, rows that break the rule afterwards: there must be none)."""
    want = F.coalesce(*[F.when(F.col("path_key") == p, d) for p, d in rules.items()])
    out = mappings.withColumn("domain_key", F.coalesce(want, F.col("domain_key")))
    wrong = (want.isNotNull() & (F.col("domain_key") != want)) | (want.isNull() & F.col("domain_key").isin(*rules.values()))
    return out, out.filter(wrong)


def renamed(df: DataFrame, col: str, pattern: str, by: str) -> DataFrame:
    return df.withColumn(col, F.regexp_replace(col, pattern, by))


def migrated(revisions: DataFrame, change: Callable[[Column], Column], dependents: dict[str, DataFrame]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(new revisions of the cards whose payload ``change`` alters, with the next number and one kind of hash; the rows of each dependent table, keyed by stable_key and revision_no, copied to them)."""
    last = F.max("revision_no").over(Window.partitionBy("stable_key"))
    cur = revisions.withColumn("last", last).filter("revision_no = last").withColumn("new", change(F.col("payload")))
    new = cur.filter(~F.col("new").eqNullSafe(F.col("payload"))).select("stable_key", (F.col("revision_no") + 1).alias("revision_no"), F.col("new").alias("payload"), F.sha2("new", 256).alias("content_hash"))
    moved = new.select("stable_key", (F.col("revision_no") - 1).alias("revision_no"))
    return new, {n: d.join(moved, ["stable_key", "revision_no"]).withColumn("revision_no", F.col("revision_no") + 1).select(*d.columns) for n, d in dependents.items()}


def run_report(items: DataFrame, run_id: str) -> DataFrame:
    """One row: the run and the numbers of its actions as a map. items: source_ref, action; of a ref that comes again the last (by seq) counts."""
    last = items.groupBy("source_ref").agg(F.max_by("action", "seq").alias("action")) if "seq" in items.columns else items
    per = last.groupBy("action").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("action", "n")))).alias("totals")).select(F.lit(run_id).alias("run_id"), "totals")

"""Topic crosswalks: what a registry of topics decides for the cards of a catalog, merged with what was accepted before.

catalog    stable_key, revision_id, content_hash, topics array<struct<title, relation>>
decisions  title, path_key, domain_key: the registry, one row a title
entries    ENTRY: a card's mapping with its pins, unmapped, proposed or accepted

Only the exact title of a card's primary topic decides; nothing is inferred. Accepted entries are kept as they are, pins and all, so that proposing and accepting again changes nothing.
All are joins by key; the registry is no larger than its topics and Spark sends it along where its size allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTRY = "stable_key string, revision_id string, content_hash string, program_key string, path_key string, domain_key string, mapping_state string, mapping_version string, source string"
KEYS = ("program_key", "path_key", "domain_key", "mapping_version")
STATES = ("unmapped", "proposed", "accepted")
_COLUMNS = [c.split()[0] for c in ENTRY.split(", ")]


def primary_topic(topics: Column) -> Column:
    """Title of the first primary topic; of the only topic where none is primary; else null."""
    first = F.get(F.filter(topics, lambda t: t["relation"] == "primary"), F.lit(0))["title"]
    return F.coalesce(first, F.when(F.size(topics) == 1, F.get(topics, F.lit(0))["title"]))


def _decided(catalog: DataFrame, decisions: DataFrame) -> DataFrame:
    own = catalog.select("stable_key", "revision_id", "content_hash", primary_topic(F.col("topics")).alias("topic"))
    return own.join(decisions.select(F.col("title").alias("topic"), F.col("path_key").alias("d_path"), F.col("domain_key").alias("d_domain")), "topic", "left")


def propose(catalog: DataFrame, preserved: DataFrame, decisions: DataFrame, program: str, version: str, source: str) -> DataFrame:
    """An entry for each card, with its ``topic``: the accepted one that is there, else a proposal if the registry knows the topic, else unmapped. Entries of cards that the catalog lacks are left out."""
    kept = preserved.filter("mapping_state = 'accepted'").select("stable_key", F.struct(*_COLUMNS).alias("kept"))
    j = _decided(catalog, decisions).join(kept, "stable_key", "left")
    known = F.col("d_path").isNotNull()
    new = {
        "stable_key": F.col("stable_key"), "revision_id": F.col("revision_id"), "content_hash": F.col("content_hash"), "program_key": F.when(known, program), "path_key": F.col("d_path"), "domain_key": F.when(known, F.col("d_domain")),
        "mapping_state": F.when(known, "proposed").otherwise("unmapped"), "mapping_version": F.when(known, version), "source": F.lit(source),
    }
    return j.select(*[F.when(F.col("kept").isNotNull(), F.col(f"kept.{c}")).otherwise(new[c]).alias(c) for c in _COLUMNS], "topic")


def accept(entries: DataFrame, catalog: DataFrame, decisions: DataFrame, program: str, version: str, source: str) -> DataFrame:
    """Entries after a review that accepts exactly what the registry decides, with their ``topic`` and whether the card is ``missing``: accepted ones stay; others are accepted if their card is in the catalog and its topic in the registry, and
    unmapped, without keys, if not. Any other state is an error."""
    j = entries.select(*_COLUMNS).join(_decided(catalog, decisions).select("stable_key", "topic", "d_path", "d_domain", F.lit(True).alias("there")), "stable_key", "left")
    state = F.lower(F.trim(F.coalesce(F.nullif(F.col("mapping_state"), F.lit("")), F.lit("unmapped"))))
    state = F.when(state.isin(*STATES), state).otherwise(F.raise_error(F.concat(F.lit("unsupported state of "), F.col("stable_key"))))
    old, known = state == "accepted", F.col("d_path").isNotNull()
    new = {"program_key": F.when(known, program), "path_key": F.col("d_path"), "domain_key": F.when(known, F.col("d_domain")), "mapping_version": F.when(known, version), "mapping_state": F.when(known, "accepted").otherwise("unmapped"), "source": F.when(known, source).otherwise(F.col("source"))}
    return j.select(*[F.when(old, F.col(c)).otherwise(new[c]).alias(c) if c in new else F.col(c) for c in _COLUMNS], "topic", F.col("there").isNull().alias("missing"))


def counters(entries: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """One row: entries by state, by path and by domain, and the titles without a decision with their cards, the most frequent first. before: the entries that a review began with, of which accepted ones count as preserved."""
    n = lambda column, where: entries.filter(where).groupBy(F.coalesce(column, F.lit("<missing topic>")).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    as_map = lambda df, name: df.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias(name))  # noqa: E731  a row a path, domain or topic
    told = F.col("mapping_state") != "unmapped"
    out = entries.agg(F.count(F.lit(1)).alias("entries"), *[F.count_if(F.col("mapping_state") == s).alias(s) for s in STATES])
    out = out.join(as_map(n(F.col("path_key"), told), "by_path")).join(as_map(n(F.col("domain_key"), told), "by_domain"))
    unknown = n(F.col("topic"), ~told).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col("k").alias("title")))).alias("u"))
    out = out.join(unknown.select(F.transform("u", lambda x: F.struct(x["title"].alias("title"), (-x["n"]).alias("cards"))).alias("unmapped_topics")))
    return out.join(before.agg(F.count_if(F.col("mapping_state") == "accepted").alias("preserved"))) if before is not None else out

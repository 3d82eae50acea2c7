"""Manifests: normalising, pins, release ids and what a release report says. A manifest's header is a dict of a few strings; its entries are a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import blank, trimmed
from ..functions.taxonomy import DISPOSITIONS, ROLES, VERSION, canonical_capability, is_deprecated, is_sha256, is_uuid, label, presentation_role, resolve_placement

PINS = ("stable_key", "revision_id", "content_hash")


def header_problem(header: dict, contract: str, *needed: str) -> str | None:
    """Code of what a header lacks."""
    get = lambda k: (header.get(k) or "").strip()
    if get("contract_version") != contract:
        return "unsupported_contract_version"
    if get("taxonomy_version") != VERSION:
        return "unsupported_taxonomy_version"
    return next((f"missing_{k}" for k in ("workspace_key", *needed, "source") if not get(k)), None)


def _text(df: DataFrame, *cols: str) -> DataFrame:
    return reduce(lambda d, c: d.withColumn(c, F.coalesce(trimmed(F.col(c)), F.lit(""))), cols, df)


def _twice(*by: str) -> Column:
    return F.count(F.lit(1)).over(Window.partitionBy(*by)) > 1


def pin_problem() -> Column:
    return F.when(~is_uuid(F.col("revision_id")), "revision_id").when(~is_sha256(F.col("content_hash")), "content_hash")


def normal_mapping(entries: DataFrame, source: str) -> DataFrame:
    """entries: PINS, program_key, path_key, domain_key, capability_key, mapping_state, mapping_version, source. The same in canonical form, and ``problem``: null for a sound row."""
    keys = ["program_key", "path_key", "domain_key", "capability_key"]
    e = _text(entries, *PINS, *keys, "mapping_state", "mapping_version", "source")
    none = reduce(lambda a, k: a & (F.col(k) == ""), keys, F.lit(True))
    state = F.when(F.col("mapping_state") != "", F.lower("mapping_state")).when(none, "unmapped").otherwise("proposed")
    e = e.withColumn("mapping_state", state).withColumn("source", F.when(F.col("source") == "", source).otherwise(F.col("source")))
    unmapped = F.col("mapping_state") == "unmapped"
    e = e.withColumn("p", resolve_placement(*[F.col(k) for k in keys], F.col("mapping_state")))
    problem = (
        F.when(F.col("stable_key") == "", "stable_key")
        .when(_twice("stable_key"), "duplicate")
        .otherwise(
            F.coalesce(
                pin_problem(),
                F.when(unmapped & ~none, "unmapped_with_keys"),
                F.when(~unmapped & (F.col("mapping_version") != "") & (F.col("mapping_version") != VERSION), "mapping_version"),
                F.when(~unmapped & is_deprecated(F.col("capability_key")), "deprecated_capability"),
                F.when(~unmapped, F.col("p.error")),
                F.when(~unmapped & (F.col("p.program_key").isNull() | F.col("p.path_key").isNull() | F.col("p.domain_key").isNull()), "incomplete_placement"),
            )
        )
    )
    e = e.withColumn("problem", problem)
    return e.select(
        *PINS, *[F.when(unmapped, "").otherwise(F.coalesce(F.col(f"p.{k}"), F.lit(""))).alias(k) for k in keys], "mapping_state", F.when(unmapped, "").otherwise(VERSION).alias("mapping_version"), "source", "problem"
    )


def normal_bindings(entries: DataFrame) -> DataFrame:
    """entries: PINS, disposition, rationale, bindings array<struct<path_key, capability_key, role, provenance, confidence>>. Canonical, with ``problem``."""
    e = _text(entries, *PINS, "disposition", "rationale").withColumn("disposition", F.lower("disposition"))
    own = F.coalesce("bindings", F.array().cast("array<struct<path_key: string, capability_key: string, role: string, provenance: string, confidence: double>>"))
    clean = lambda b: F.struct(trimmed(b["path_key"]).alias("path_key"), F.coalesce(canonical_capability(b["capability_key"]), trimmed(b["capability_key"])).alias("capability_key"), label(b["role"]).alias("role"), trimmed(b["provenance"]).alias("provenance"), b["confidence"].cast("double").alias("confidence"))
    any_ = lambda test: F.exists(own, test)
    bound = F.col("disposition") == "bound"
    e = e.withColumn("clean", F.transform(own, clean))
    identity = F.transform("clean", lambda b: F.concat_ws("\t", b["path_key"], b["capability_key"], b["role"]))
    problem = (
        F.when(~F.col("stable_key").startswith("question."), "stable_key")
        .when(_twice("stable_key"), "duplicate")
        .when(~F.col("disposition").isin(*DISPOSITIONS), "disposition")
        .otherwise(
            F.coalesce(
                pin_problem(),
                F.when(F.col("rationale") == "", "rationale"),
                F.when(bound & (F.size(own) == 0), "bound_without_binding"),
                F.when(~bound & (F.size(own) > 0), "unbound_with_binding"),
                F.when(any_(lambda b: blank(b["path_key"]) | blank(b["capability_key"])), "binding_keys"),
                F.when(any_(lambda b: ~label(b["role"]).isin(*ROLES)), "binding_role"),
                F.when(any_(lambda b: blank(b["provenance"])), "binding_provenance"),
                F.when(any_(lambda b: is_deprecated(b["capability_key"])), "deprecated_capability"),
                F.when(any_(lambda b: ~trimmed(b["capability_key"]).startswith("capability.")), "binding_capability"),
                F.when(any_(lambda b: F.coalesce((b["confidence"] < 0) | (b["confidence"] > 1), F.lit(False))), "binding_confidence"),
                F.when(F.size(F.array_distinct(identity)) < F.size(identity), "duplicate_binding"),
            )
        )
    )
    return e.withColumn("problem", problem).select(*PINS, "disposition", "rationale", F.col("clean").alias("bindings"), "problem")


def normal_targets(targets: DataFrame) -> DataFrame:
    """targets: path_key, capability_key, mandatory, minimum_primary_questions, minimum_supporting_prompts, rationale. Canonical, with ``problem``."""
    t = _text(targets, "path_key", "capability_key", "rationale")
    low = F.least("minimum_primary_questions", "minimum_supporting_prompts") < 0
    problem = (
        F.when(~F.col("path_key").startswith("path.") | ~F.col("capability_key").startswith("capability."), "invalid_target_identity")
        .when(is_deprecated(F.col("capability_key")), "deprecated_capability")
        .when(low, "invalid_target_count")
        .when(F.col("mandatory") & (F.col("minimum_primary_questions") == 0), "empty_mandatory_capability")
        .when(F.col("rationale") == "", "missing_rationale")
        .when(_twice("path_key", "capability_key"), "duplicate_target")
    )
    return t.withColumn("problem", problem)


def normal_ledger(cards: DataFrame) -> DataFrame:
    """cards: PINS, disposition, rationale. Canonical, with ``problem``."""
    c = _text(cards, *PINS, "disposition", "rationale").withColumn("content_hash", F.lower("content_hash")).withColumn("disposition", F.lower("disposition"))
    problem = (
        F.when(~F.col("stable_key").startswith("question."), "invalid_card_identity")
        .when(~is_uuid(F.col("revision_id")), "invalid_card_revision")
        .when(~is_sha256(F.col("content_hash")), "invalid_card_hash")
        .when(~F.col("disposition").isin("core", "supplemental", "quarantined"), "invalid_card_disposition")
        .when(F.col("rationale") == "", "missing_rationale")
        .when(_twice("stable_key"), "duplicate_card")
    )
    return c.withColumn("problem", problem)


def digest(rows: DataFrame, *order: str, buckets: int = 4096) -> DataFrame:
    """One row, ``digest``: of all rows in the order of ``order``, by a tree: rows are dealt to buckets by their keys, each bucket's sorted
    rows give one digest, and the digests in order of the buckets the whole. No string of all rows is made; the number of buckets is part of the definition.
    """
    key = F.concat_ws("\t", *[F.col(o).cast("string") for o in order])
    row = rows.select(F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long").alias("b"), F.struct(key.alias("k"), F.sha2(F.to_json(F.struct(*sorted(rows.columns))), 256).alias("v")).alias("r"))
    leaf = row.groupBy((F.col("b") % buckets).alias("b")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["v"]), ""), 256).alias("v"))
    return leaf.agg(F.sha2(F.coalesce(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "v"))), lambda r: F.concat(r["b"].cast("string"), F.lit(":"), r["v"])), ","), F.lit("")), 256).alias("digest"))


def release_id(prefix: str, header: dict, entries: DataFrame, *order: str) -> str:
    """Prefix and 16 hex digits of a digest of the header's pins and the entries, whatever their order."""
    import hashlib
    import json

    seed = json.dumps({k: (v or "").strip() for k, v in sorted(header.items())}, sort_keys=True) + digest(entries, *order).first()[0]
    return prefix + hashlib.sha256(seed.encode()).hexdigest()[:16]


def mapping_report(entries: DataFrame, current: DataFrame) -> DataFrame:
    """One row: how the normalised entries cover the current cards (PINS): covered, missing, extra, stale (revision or hash), and blocked."""
    e = entries.select("stable_key", F.struct("revision_id", F.lower("content_hash").alias("content_hash")).alias("m"))
    c = current.select("stable_key", F.struct("revision_id", F.lower("content_hash").alias("content_hash")).alias("c"))
    both = e.join(c, "stable_key", "full_outer")
    m, c = F.col("m"), F.col("c")
    out = both.agg(
        F.count_if(m.isNotNull() & c.isNotNull() & (m == c)).alias("covered"),
        F.count_if(m.isNull()).alias("missing"),
        F.count_if(c.isNull()).alias("extra"),
        F.count_if(m["revision_id"] != c["revision_id"]).alias("stale_revision"),
        F.count_if(m["content_hash"] != c["content_hash"]).alias("stale_hash"),
    )
    return out.withColumn("blocked", F.col("missing") + F.col("extra") + F.col("stale_revision") + F.col("stale_hash") > 0)


def unmapped(current: DataFrame) -> DataFrame:
    """The manifest that says of every card that it is unmapped."""
    return current.select(*PINS, *[F.lit("").alias(k) for k in ("program_key", "path_key", "domain_key", "capability_key")], F.lit("unmapped").alias("mapping_state"), F.lit("").alias("mapping_version"), F.lit("audit").alias("source"))


def generated_bindings(cards: DataFrame, capabilities: DataFrame, proposals: DataFrame, aliases: DataFrame) -> DataFrame:
    """cards: PINS, path_key, capability_key (blank: theory); capabilities: key of the active ones; aliases: alias, key; proposals: stable_key, revision_id, path_key,
    capability_key, role, provenance, confidence, all accepted. Entries of a manifest: bound, needs_new_capability or theory_only; accepted proposals for the current revision bind."""
    known = capabilities.select(F.col("key").alias("capability_key"), F.lit(True).alias("active"))
    of = aliases.select(F.col("alias").alias("capability_key"), F.col("key").alias("canonical"))
    c = cards.join(of, "capability_key", "left").withColumn("capability_key", F.coalesce("canonical", "capability_key")).join(known, "capability_key", "left")
    own = F.struct("path_key", "capability_key", F.lit("primary").alias("role"), F.lit("mapping").alias("provenance"), F.lit(None).cast("double").alias("confidence"))
    c = c.withColumn("own", F.when(F.col("active"), F.array(own)).otherwise(F.array().cast("array<struct<path_key: string, capability_key: string, role: string, provenance: string, confidence: double>>")))
    p = proposals.groupBy("stable_key", "revision_id").agg(F.array_sort(F.collect_set(F.struct("path_key", "capability_key", "role", "provenance", F.col("confidence").cast("double").alias("confidence")))).alias("more"))
    e = c.join(p, ["stable_key", "revision_id"], "left")
    have = F.transform("own", lambda b: F.concat_ws("\t", b["path_key"], b["capability_key"], b["role"]))
    fresh = F.filter("more", lambda b: ~F.array_contains(have, F.concat_ws("\t", b["path_key"], b["capability_key"], b["role"])))
    e = e.withColumn("bindings", F.concat("own", F.coalesce(fresh, F.array().cast("array<struct<path_key: string, capability_key: string, role: string, provenance: string, confidence: double>>"))))
    bound = F.size("bindings") > 0
    disposition = F.when(bound, "bound").when(blank(F.col("capability_key")), "theory_only").otherwise("needs_new_capability")
    why = F.when(bound, "reviewed capability").when(blank(F.col("capability_key")), "no executable capability").otherwise("capability is not in the active registry")
    return e.select(*PINS, disposition.alias("disposition"), why.alias("rationale"), "bindings")


def coverage_report(targets: DataFrame, ledger: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(targets with the distinct cards that they have and whether they are ready; problems (code, key) that block the release): a ledger row for each entry of the binding release."""
    l, e = ledger.alias("l"), entries.alias("e")
    both = l.join(e, F.col("l.stable_key") == F.col("e.stable_key"), "full_outer")
    key = F.coalesce(F.col("l.stable_key"), F.col("e.stable_key"))
    stale = (F.col("l.revision_id") != F.col("e.revision_id")) | (F.lower("l.content_hash") != F.lower("e.content_hash"))
    kind, n = F.col("l.disposition"), F.size(F.coalesce(F.col("e.bindings"), F.array()))
    code = (
        F.when(F.col("e.stable_key").isNull(), "unknown_card")
        .when(F.col("l.stable_key").isNull(), "incomplete_card_ledger")
        .when(stale, "stale_card_pin")
        .when((kind == "core") & ((F.col("e.disposition") != "bound") | (n == 0)), "unbound_core_card")
        .when((kind == "supplemental") & (F.col("e.disposition") == "rejected"), "rejected_card_marked_supplemental")
        .when((kind == "quarantined") & ((F.col("e.disposition") == "bound") | (n > 0)), "quarantined_card_is_bound")
    )
    problems = both.select(code.alias("code"), key.alias("key")).filter("code is not null")
    core = both.filter((kind == "core") & F.col("e.stable_key").isNotNull()).select(key.alias("stable_key"), F.explode("e.bindings").alias("b")).select("stable_key", "b.path_key", "b.capability_key", presentation_role(F.col("b.role")).alias("role"))
    t = targets.select("path_key", "capability_key", "mandatory", "minimum_primary_questions", "minimum_supporting_prompts")
    lost = core.join(t, ["path_key", "capability_key"], "left_anti").select(F.lit("core_binding_without_target").alias("code"), F.concat_ws(" ", "stable_key", "path_key", "capability_key").alias("key"))
    count = lambda r: F.count_distinct(F.when(F.col("role") == r, F.col("stable_key")))
    per = core.groupBy("path_key", "capability_key").agg(count("primary_question").alias("primary_questions"), count("supporting_prompt").alias("supporting_prompts"))
    out = t.join(per, ["path_key", "capability_key"], "left").fillna(0, ["primary_questions", "supporting_prompts"])
    out = out.withColumn("ready", (F.col("primary_questions") >= F.col("minimum_primary_questions")) & (F.col("supporting_prompts") >= F.col("minimum_supporting_prompts")))
    gap = out.filter("not ready").select(F.lit("target_role_gap").alias("code"), F.concat_ws(" ", "path_key", "capability_key").alias("key"))
    return out, problems.union(lost).union(gap)


def placement_report(cards: DataFrame, proposals: DataFrame) -> DataFrame:
    """cards: stable_key of the published production ones; proposals: stable_key, topic_key, decision. One row: exactly one sound proposal a card is asked for."""
    p = proposals.groupBy("stable_key").agg(F.count(F.lit(1)).alias("n"), F.min("topic_key").alias("topic_key"), F.min("decision").alias("decision"))
    c = cards.select("stable_key").join(p, "stable_key", "left").fillna(0, ["n"])
    one = F.col("n") == 1
    sound = one & ~blank(F.col("topic_key")) & F.coalesce(F.col("decision").isin("proposed", "accepted"), F.lit(False))
    out = c.agg(
        F.count(F.lit(1)).alias("eligible"),
        F.count_if(F.col("n") == 0).alias("missing"),
        F.count_if(F.col("n") > 1).alias("multiple"),
        F.count_if(one & blank(F.col("topic_key"))).alias("without_topic"),
        F.count_if(one & ~blank(F.col("topic_key")) & ~sound).alias("undecided"),
        F.count_if(sound & (F.col("decision") == "proposed")).alias("proposed"),
        F.count_if(sound & (F.col("decision") == "accepted")).alias("accepted"),
    )
    return out.withColumn("blocked", F.col("missing") + F.col("multiple") + F.col("without_topic") + F.col("undecided") > 0)

"""Reviews of imports: candidates for what may be there already, the status of a stage, decisions, and the gate before publishing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import nearest_pairs

LEXICAL, SEMANTIC, MOST = 0.55, 0.80, 25
TYPES = ("exact_duplicate", "lexical_neighbor", "semantic_neighbor")


def best(candidates: DataFrame, score: str, most: int) -> DataFrame:
    """The ``most`` best of each stage, ties by key."""
    w = Window.partitionBy("stage_id").orderBy(F.desc(score), "related_key")
    return candidates.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= most).drop("r")


def import_candidates(cards: DataFrame, current: DataFrame, similar, lexical: float = LEXICAL, semantic: float = SEMANTIC, most: int = MOST, settled=lambda df: df) -> DataFrame:
    """stage_id, related_key, candidate_type, exact_score, lexical_score, semantic_score: what each imported card may repeat.

    cards: stage_id, stable_key, body_hash (of the payload without its identity), prompt, vector; current: stable_key, body_hash, prompt, vector of the published production
    cards. A pair is exact before lexical before semantic. ``similar(left, right, threshold)`` gives a, b, similarity of prompts.
    ``settled(df)`` may write the lexical candidates, which are read twice, so that prompts are compared once.
    """
    none = F.lit(None).cast("double")
    pair = ["stage_id", "related_key"]
    exact = cards.alias("a").join(current.alias("b"), (F.col("a.body_hash") == F.col("b.body_hash")) & (F.col("a.stable_key") != F.col("b.stable_key")))
    exact = exact.select("stage_id", F.col("b.stable_key").alias("related_key"), F.lit(1.0).alias("exact_score"))
    other = (F.col("own") != F.col("related_key")) & ~F.coalesce(F.col("own_body") == F.col("body"), F.lit(False))
    mine = cards.select("stage_id", F.col("stable_key").alias("own"), F.col("body_hash").alias("own_body"), "prompt", "vector")
    theirs = current.select(F.col("stable_key").alias("related_key"), F.col("body_hash").alias("body"), "prompt", "vector")
    # prompts meet once, however many cards have them; of the cards of a prompt those with the smallest keys can be chosen, and as many more as a stage's own card and body may take away
    asked = cards.groupBy("prompt").agg(F.min("stage_id").alias("key"))
    held = theirs.groupBy("prompt").agg(F.min("related_key").alias("key"))
    first = lambda by, n: F.row_number().over(Window.partitionBy(*by).orderBy("related_key")) <= n
    few = theirs.select("related_key", "body", "prompt").withColumn("one", first(["prompt", "body"], most + 1)).filter("one")
    few = few.withColumn("one", first(["prompt"], 2 * (most + 1))).filter("one").join(held, "prompt").select("related_key", "body", F.col("key").alias("b"))
    words = similar(asked, held, lexical).join(mine.select("stage_id", "own", "own_body", "prompt").join(asked, "prompt").select("stage_id", "own", "own_body", F.col("key").alias("a")), "a")
    words = settled(best(words.join(few, "b").filter(other).select(*pair, F.col("similarity").alias("lexical_score")), "lexical_score", most))
    near = nearest_pairs(mine.select("stage_id", "own", "own_body", F.col("vector").alias("v")), theirs.select("related_key", "body", F.col("vector").alias("w")), semantic)
    near = near.filter(other).select(*pair, F.col("similarity").alias("semantic_score"))
    near = best(near.join(words, pair, "left_anti"), "semantic_score", most)
    return (
        exact.select(*pair, F.lit(TYPES[0]).alias("candidate_type"), "exact_score", none.alias("lexical_score"), none.alias("semantic_score"))
        .unionByName(words.select(*pair, F.lit(TYPES[1]).alias("candidate_type"), none.alias("exact_score"), "lexical_score", none.alias("semantic_score")))
        .unionByName(near.select(*pair, F.lit(TYPES[2]).alias("candidate_type"), none.alias("exact_score"), none.alias("lexical_score"), "semantic_score"))
    )


def merged_candidates(old: DataFrame, new: DataFrame) -> DataFrame:
    """Candidates found again keep their decision and the scores that the new look did not give."""
    key = ["stage_id", "related_key", "candidate_type"]
    both = old.alias("o").join(new.alias("n"), key, "full_outer")
    return both.select(*key, *[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in ("exact_score", "lexical_score", "semantic_score")], F.coalesce(F.col("o.decision"), F.lit("open")).alias("decision"))


def stage_status(stages: DataFrame, candidates: DataFrame) -> DataFrame:
    """stages (stage_id, status) with the status that their candidates (stage_id, decision) give, their number, and that of the open ones. Published and discarded stages stay."""
    per = candidates.groupBy("stage_id").agg(F.count(F.lit(1)).alias("candidates"), F.count_if(F.col("decision") == "open").alias("open"), F.bool_or(F.col("decision").isin("open", "merge")).alias("held"))
    out = stages.drop("candidates", "open").join(per, "stage_id", "left").fillna(0, ["candidates", "open"])
    return out.withColumn("status", F.when(F.col("status").isin("published", "discarded"), F.col("status")).when(F.col("held"), "blocked").otherwise("cleared")).drop("held")


def decided(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """candidates with the decisions (stage_id, related_key, decision) laid over."""
    d = decisions.select("stage_id", "related_key", F.col("decision").alias("new"))
    return candidates.join(d, ["stage_id", "related_key"], "left").withColumn("decision", F.coalesce("new", "decision")).drop("new")


def publishable(stages: DataFrame, current: DataFrame) -> DataFrame:
    """stages with ``ready``: cleared or published, or the card is the current one unchanged. stages: stage_id, stable_key, content_hash, status; current: stable_key, content_hash."""
    c = current.select("stable_key", F.col("content_hash").alias("now"))
    return stages.join(c, "stable_key", "left").withColumn("ready", F.col("status").isin("cleared", "published") | F.coalesce(F.col("now") == F.col("content_hash"), F.lit(False))).drop("now")


def related_edges(candidates: DataFrame, stages: DataFrame, edges: DataFrame) -> DataFrame:
    """Proposed ``related`` edges from neighbour candidates, with the semantic score for confidence, else the lexical one; edges that are there stay as they are."""
    near = candidates.filter(F.col("candidate_type") != TYPES[0]).join(stages.select("stage_id", F.col("stable_key").alias("src")), "stage_id")
    new = near.groupBy("src", F.col("related_key").alias("dst")).agg(F.max(F.coalesce("semantic_score", "lexical_score")).alias("confidence")).withColumn("kind", F.lit("related")).withColumn("status", F.lit("proposed"))
    return edges.unionByName(new.join(edges, ["src", "dst", "kind"], "left_anti").select(*edges.columns), allowMissingColumns=True)


def pair_key(a: str, b: str) -> tuple[F.Column, F.Column]:
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def duplicate_decisions(state: DataFrame, change: DataFrame) -> DataFrame:
    """state (a, b, decision) with the decisions of ordered pairs (change: x, y, decision) laid over; ``overwrote`` tells a decision that was another one before."""
    new = change.select(*pair_key("x", "y"), F.col("decision").alias("new")).filter("a <> b")
    both = state.join(new, ["a", "b"], "full_outer")
    return both.select("a", "b", F.coalesce("new", "decision").alias("decision"), F.coalesce(~F.col("decision").isin("open") & (F.col("new") != F.col("decision")), F.lit(False)).alias("overwrote"))


def duplicate_groups(prompts: DataFrame, decisions: DataFrame) -> DataFrame:
    """prompts: key, prompt (comparable, not blank); decisions: a, b (ordered), decision. Groups of equal prompts: keys, number of pairs, of decided pairs, resolved.

    A group of m keys has m (m - 1) / 2 pairs; they are counted, not made: only decisions are joined.
    """
    g = prompts.filter("prompt <> ''").groupBy("prompt").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first_key")).filter("n > 1")
    terminal = decisions.filter(F.col("decision").isin("keep_separate", "merge", "not_duplicate"))
    x, y = prompts.select(F.col("key").alias("a"), F.col("prompt").alias("p")), prompts.select(F.col("key").alias("b"), F.col("prompt").alias("q"))
    done = terminal.select("a", "b").distinct().join(x, "a").join(y, "b").filter("p = q").groupBy(F.col("p").alias("prompt")).agg(F.count(F.lit(1)).alias("decided"))
    out = g.join(done, "prompt", "left").fillna(0, ["decided"]).withColumn("pairs", (F.col("n") * (F.col("n") - 1) / 2).cast("long"))
    return out.withColumn("resolved", F.col("decided") == F.col("pairs"))


def calibration(pairs: DataFrame) -> DataFrame:
    """One row of tp, fp, fn, tn, precision and recall (1 where nothing was to be found). pairs: truth, guess."""
    t, g = F.col("truth"), F.col("guess")
    out = pairs.agg(F.count_if(t & g).alias("tp"), F.count_if(~t & g).alias("fp"), F.count_if(t & ~g).alias("fn"), F.count_if(~t & ~g).alias("tn"))
    share = lambda a, b: F.when(F.col(a) + F.col(b) == 0, 1.0).otherwise(F.col(a) / F.greatest(F.col(a) + F.col(b), F.lit(1)))
    return out.withColumn("precision", share("tp", "fp")).withColumn("recall", share("tp", "fn"))

"""Explainable multi-stage search: exact identity, words, trigrams and vectors, fused by reciprocal rank; and nearest vectors.

Words: a query is alternatives (OR) of terms, "phrases" and -exclusions; all of an alternative must hold. Their score is the density of covers: the
sum of 1 / length over the shortest stretches of a document that hold every term (after Clarke, Cormack and Tudhope).
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import terms, trigrams
from ..functions.rules import ACCENTED, PLAIN
from ..operators.blocks import nearest_of_groups, nearest_pairs
from ..operators.ranks import ranked
from ..sources.cards import cards, table
from ..sources.scratch import Scratch
from .registry import register
from .sql import GRAMS

K, MIN_RANK, GATE_TRIGRAM, GATE_SEMANTIC, MIN_SEMANTIC = 60, 0.02, 0.15, 0.50, 0.505
STAGES = ("exact", "fts", "trigram", "semantic")
#: A request is a bounded set of queries, which the driver parses; more are an error.
MOST_QUERIES = 20_000
_PLAIN = str.maketrans(ACCENTED, PLAIN) | {ord("ß"): "ss", ord("æ"): "ae", ord("œ"): "oe", ord("Æ"): "AE", ord("Œ"): "OE"}


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.translate(_PLAIN).lower())


def parse_query(text: str) -> list[dict]:
    """Alternatives, each with the words that it needs, its phrases (of two words or more) and its exclusions. One with nothing to look for is left out."""
    out = [{"words": [], "phrases": [], "nots": []}]
    parts, after = re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', text), False
    for at, (minus, quoted, bare) in enumerate(parts):
        # as in websearch_to_tsquery, an OR stands between two others; at an end or behind another OR it is a word
        operator, after = bare.lower() == "or" and not minus and after and at + 1 < len(parts), True
        if operator:
            after = False
            out.append({"words": [], "phrases": [], "nots": []})
            continue
        found = words_of(quoted or bare)
        if not found:
            continue
        if minus:
            out[-1]["nots"].append(" ".join(found))
            continue
        out[-1]["words"] += [w for w in found if w not in out[-1]["words"]]
        if quoted and len(found) > 1:
            out[-1]["phrases"].append(" ".join(found))
    return [a for a in out if a["words"]]


def cover_density(places, n_terms) -> F.Column:
    """places: array<struct<pos, t>> in order of pos, t of 0 .. n_terms - 1. One walk along them: wherever the shortest cover that ends here begins later than the one before, it counts 1 / length."""
    first = F.struct(F.array_repeat(F.lit(-1), n_terms.cast("int")).alias("last"), F.lit(-1).alias("begin"), F.lit(0.0).alias("score"))

    def step(acc, p):
        last = F.transform(acc["last"], lambda x, i: F.when(i == p["t"], p["pos"]).otherwise(x))
        low = F.array_min(last)
        new = low > acc["begin"]
        return F.struct(last.alias("last"), F.when(new, low).otherwise(acc["begin"]).alias("begin"), (acc["score"] + F.when(new, 1.0 / (p["pos"] - low + 1)).otherwise(0.0)).alias("score"))

    return F.aggregate(places, first, step, lambda acc: acc["score"])


def search(
    spark: SparkSession, corpus: DataFrame, queries: DataFrame, vectors: DataFrame | None = None, query_vectors: DataFrame | None = None, locale: str | None = None, topic: str | None = None, level: str | None = None,
    limit: int = 20, min_rank: float = MIN_RANK, min_semantic: float = MIN_SEMANTIC,
) -> DataFrame:
    """corpus: stable_key, slug, prompt, text and the filtered columns; queries: query_id, query; vectors: stable_key, vector; query_vectors: query_id, vector (without both there is no
    semantic stage). query_id, pos, stable_key, rank_score, match_stages and each stage's score.

    Words and trigrams of the corpus meet those of the queries, a bounded set that goes with the tasks, before anything is shuffled; of texts only those that hold all
    words of an alternative are. Hits are ranked over many tasks, however many a query has; of the last order only ``limit`` rows a query leave a task.
    """
    for c, v in (("locale", locale), ("topic", topic), ("level", level)):
        if v:
            corpus = corpus.filter(F.lower(c) == v.lower())
    limit = min(max(limit, 1), 100)
    asked = queries.select("query_id", "query").limit(MOST_QUERIES + 1).collect()
    if len(asked) > MOST_QUERIES:
        raise ValueError(f"more than {MOST_QUERIES} queries in a request")
    parsed = [(r["query_id"], alt, a) for r in asked for alt, a in enumerate(parse_query(r["query"] or ""))]
    wanted = spark.createDataFrame([(q, alt, w, len(a["words"])) for q, alt, a in parsed for w in a["words"]], "query_id long, alt int, item string, n int")
    q = queries.withColumn("grams", trigrams(F.col("query")))
    grams = q.select("query_id", F.size("grams").alias("n"), F.explode("grams").alias("item"))
    # lists are made once, in a projection of their own: within the generator they would be made for each use
    prompts = corpus.select("stable_key", trigrams(F.col("prompt")).alias("grams")).select("stable_key", F.size("grams").alias("nd"), F.explode("grams").alias("item"))
    met = prompts.join(F.broadcast(grams), "item").groupBy("query_id", "stable_key").agg(F.count(F.lit(1)).alias("common"), F.first("nd").alias("nd"), F.first("n").alias("n"))
    fuzzy = met.select("query_id", "stable_key", (F.col("common") / (F.col("nd") + F.col("n") - F.col("common"))).alias("trigram")).filter(F.col("trigram") >= GATE_TRIGRAM)
    # first the documents that hold all words of an alternative; their places are looked up only then
    distinct = corpus.select("stable_key", F.array_distinct(terms(F.col("text"))).alias("words")).select("stable_key", F.explode("words").alias("item"))
    hits = distinct.join(F.broadcast(wanted), "item").groupBy("query_id", "alt", "stable_key").agg(F.count(F.lit(1)).alias("hits"), F.first("n").alias("n")).filter("hits = n").select("query_id", "alt", "stable_key")
    asked_for = spark.createDataFrame([(q_, alt, a["words"], a["phrases"], a["nots"]) for q_, alt, a in parsed], "query_id long, alt int, need array<string>, phrases array<string>, nots array<string>")
    found = corpus.select("stable_key", terms(F.col("text")).alias("words")).join(hits.join(F.broadcast(asked_for), ["query_id", "alt"]), "stable_key")
    whole = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    there = lambda p: whole.contains(F.concat(F.lit(" "), p, F.lit(" ")))
    found = found.filter(((F.size("phrases") == 0) | F.forall("phrases", there)) & ((F.size("nots") == 0) | ~F.exists("nots", there)))
    places = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("pos"), (F.array_position("need", w) - 1).cast("int").alias("t"))), lambda x: x["t"] >= 0)
    found = found.select("query_id", "stable_key", F.size("need").alias("n"), places.alias("places"))
    full = found.groupBy("query_id", "stable_key").agg(F.max(cover_density(F.col("places"), F.col("n"))).alias("fts"))
    name = queries.select("query_id", F.lower("query").alias("name"))
    exact = name.join(corpus.select("stable_key", F.explode(F.array_distinct(F.array(F.lower("stable_key"), F.lower("slug")))).alias("name")), "name").select("query_id", "stable_key", F.lit(1.0).alias("exact")).distinct()
    hits = [exact, full, fuzzy]
    if vectors is not None and query_vectors is not None:
        near = nearest_pairs(query_vectors.select(F.col("query_id").alias("q"), F.col("vector").alias("v")), vectors.join(corpus.select("stable_key"), "stable_key", "left_semi").select("stable_key", F.col("vector").alias("w")), GATE_SEMANTIC)
        hits.append(near.select(F.col("q").alias("query_id"), "stable_key", F.col("similarity").alias("semantic")))
    # one row a hit of a stage, so that all stages are ranked together and meet in one grouping
    hits = [h.select(F.lit(i).alias("stage"), "query_id", "stable_key", F.col(STAGES[i]).alias("found")) for i, h in enumerate(hits)]
    places = ranked(reduce(DataFrame.unionByName, hits), ["query_id", "stage"], [F.desc(F.round("found", 9)), F.col("stable_key")], Scratch(spark, "search"))
    of = lambda c, i: F.max(F.when(F.col("stage") == i, F.col(c)))
    both = places.groupBy("query_id", "stable_key").agg(*[of("found", i).alias(c) for i, c in enumerate(STAGES)], *[of("rank", i).alias(f"{c}_rank") for i, c in enumerate(STAGES)])
    score = sum((F.coalesce(1.0 / (K + F.col(f"{c}_rank")), F.lit(0.0)) for c in STAGES), F.lit(0.0))
    kept = both.withColumn("score", score).filter((F.col("score") >= min_rank) | F.col("exact").isNotNull() | (F.col("semantic") >= min_semantic))
    top = kept.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "stable_key"))).filter(F.col("pos") <= limit)
    told = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in STAGES]))
    return top.select("query_id", "pos", "stable_key", F.round("score", 6).alias("rank_score"), F.array_join(told, ",").alias("match_stages"), *[F.round(F.coalesce(c, F.lit(0.0)), 6).alias(f"{c}_score") for c in STAGES])


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First four words of each benchmark item; of the items 0 to 2 also a phrase, alternatives and an exclusion; and one exact key."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.split("text", " ").alias("w"))
    w = lambda i: F.col("w")[i]
    out = b.select(F.col("item_id").alias("query_id"), F.array_join(F.slice("w", 1, 4), " ").alias("query"))
    more = F.when(F.col("item_id") == 0, F.concat(F.lit('"'), w(0), F.lit(" "), w(1), F.lit('"'))).when(F.col("item_id") == 1, F.concat_ws(" ", w(0), w(1), F.lit("or"), w(2), w(3))).otherwise(F.concat(w(0), F.lit(" "), w(1), F.lit(" -"), w(2)))
    out = out.unionByName(b.filter("item_id < 3").select((-2 - F.col("item_id")).alias("query_id"), more.alias("query")))
    return out.union(spark.sql("SELECT -1L AS query_id, 'question.d7' AS query"))


_WORDS = r"list_filter(regexp_split_to_array(lower(strip_accents({0})), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"


@register(
    rf""", b AS (SELECT item_id, string_split(text, ' ') AS w FROM benchmark),
    q0 AS (SELECT item_id AS query_id, array_to_string(list_slice(w, 1, 4), ' ') AS query FROM b
      UNION ALL SELECT 0 - 2 - item_id, CASE item_id WHEN 0 THEN '"' || w[1] || ' ' || w[2] || '"' WHEN 1 THEN w[1] || ' ' || w[2] || ' or ' || w[3] || ' ' || w[4] ELSE w[1] || ' ' || w[2] || ' -' || w[3] END FROM b WHERE item_id < 3
      UNION ALL SELECT -1, 'question.d7'),
    cut AS (SELECT item_id, w, CASE WHEN lower(w[2]) = 'or' AND len(w) >= 3 THEN 2 WHEN lower(w[3]) = 'or' AND len(w) >= 4 THEN 3 END AS o FROM b),
    a AS (SELECT item_id AS query_id, 0 AS alt, array_to_string(list_slice(w, 1, coalesce(o - 1, 4)), ' ') AS need, '' AS phrase, '' AS avoid FROM cut
      UNION ALL SELECT item_id, 1, array_to_string(list_slice(w, o + 1, 4), ' '), '', '' FROM cut WHERE o IS NOT NULL
      UNION ALL SELECT -1, 0, 'question.d7', '', ''
      UNION ALL SELECT -2, 0, w[1] || ' ' || w[2], w[1] || ' ' || w[2], '' FROM b WHERE item_id = 0
      UNION ALL SELECT -3, 0, w[1] || ' ' || w[2], '', '' FROM b WHERE item_id = 1
      UNION ALL SELECT -3, 1, w[3] || ' ' || w[4], '', '' FROM b WHERE item_id = 1
      UNION ALL SELECT -4, 0, w[1] || ' ' || w[2], '', w[3] FROM b WHERE item_id = 2),
    alts AS (SELECT query_id, alt, list_distinct({_WORDS.format('need')}) AS need, array_to_string({_WORDS.format('phrase')}, ' ') AS phrase, array_to_string({_WORDS.format('avoid')}, ' ') AS avoid FROM a),
    d AS (SELECT doc_id, stable_key, slug, {_WORDS.format('text')} AS words, {GRAMS.format('prompt')} AS g FROM cards),
    hit AS (SELECT query_id, alt, stable_key, need, words FROM alts, d WHERE len(need) > 0 AND list_has_all(words, need)
      AND (phrase = '' OR contains(' ' || array_to_string(words, ' ') || ' ', ' ' || phrase || ' ')) AND (avoid = '' OR NOT contains(' ' || array_to_string(words, ' ') || ' ', ' ' || avoid || ' '))),
    occ AS (SELECT * FROM (SELECT query_id, alt, stable_key, len(need) AS n, need, unnest(words) AS term, generate_subscripts(words, 1) AS pos FROM hit) WHERE list_contains(need, term)),
    ends AS (SELECT query_id, alt, stable_key, n, pos, min(m) AS low FROM (
      SELECT e.query_id, e.alt, e.stable_key, e.n, e.pos, o.term, max(o.pos) AS m FROM occ e JOIN occ o ON e.query_id = o.query_id AND e.alt = o.alt AND e.stable_key = o.stable_key AND o.pos <= e.pos GROUP BY ALL)
      GROUP BY ALL HAVING count(*) = n),
    covers AS (SELECT query_id, alt, stable_key, low, min(pos) AS pos FROM ends GROUP BY ALL),
    f AS (SELECT query_id, stable_key, max(s) AS fts FROM (SELECT query_id, alt, stable_key, sum(1.0::DOUBLE / (pos - low + 1)) AS s FROM covers GROUP BY ALL) GROUP BY ALL),
    t AS (SELECT * FROM (SELECT query_id, stable_key, len(list_intersect(g, qg)) * 1.0::DOUBLE / nullif(len(g) + len(qg) - len(list_intersect(g, qg)), 0) AS trigram FROM (SELECT query_id, {GRAMS.format('query')} AS qg FROM q0), d) WHERE trigram >= 0.15),
    x AS (SELECT query_id, stable_key, 1.0::DOUBLE AS exact FROM q0, d WHERE lower(query) IN (lower(stable_key), lower(slug))),
    v AS (SELECT * FROM (SELECT e.vec_id AS query_id, d.stable_key, list_dot_product(e.embedding::DOUBLE[], o.embedding::DOUBLE[]) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(o.embedding::DOUBLE[], o.embedding::DOUBLE[]))) AS semantic
      FROM embeddings e JOIN benchmark ON vec_id = item_id CROSS JOIN embeddings o JOIN d ON d.doc_id = o.vec_id) WHERE semantic >= 0.5),
    c AS (SELECT * FROM f FULL JOIN t USING (query_id, stable_key) FULL JOIN x USING (query_id, stable_key) FULL JOIN v USING (query_id, stable_key)),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(exact, 9) DESC NULLS LAST, stable_key) AS re, row_number() OVER (PARTITION BY query_id ORDER BY round(fts, 9) DESC NULLS LAST, stable_key) AS rf,
      row_number() OVER (PARTITION BY query_id ORDER BY round(trigram, 9) DESC NULLS LAST, stable_key) AS rt, row_number() OVER (PARTITION BY query_id ORDER BY round(semantic, 9) DESC NULLS LAST, stable_key) AS rs FROM c),
    s AS (SELECT *, CASE WHEN exact IS NULL THEN 0 ELSE 1.0::DOUBLE / (60 + re) END + CASE WHEN fts IS NULL THEN 0 ELSE 1.0::DOUBLE / (60 + rf) END + CASE WHEN trigram IS NULL THEN 0 ELSE 1.0::DOUBLE / (60 + rt) END + CASE WHEN semantic IS NULL THEN 0 ELSE 1.0::DOUBLE / (60 + rs) END AS score FROM r),
    n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, stable_key) AS pos FROM s WHERE score >= 0.02 OR exact IS NOT NULL OR semantic >= 0.505)
    SELECT query_id, pos::INT AS pos, stable_key, round(score, 6) AS rank_score, concat_ws(',', CASE WHEN exact IS NOT NULL THEN 'exact' END, CASE WHEN fts IS NOT NULL THEN 'fts' END, CASE WHEN trigram IS NOT NULL THEN 'trigram' END, CASE WHEN semantic IS NOT NULL THEN 'semantic' END) AS match_stages,
      round(coalesce(exact, 0), 6) AS exact_score, round(coalesce(fts, 0), 6) AS fts_score, round(coalesce(trigram, 0), 6) AS trigram_score, round(coalesce(semantic, 0), 6) AS semantic_score FROM n WHERE pos <= 20 /* FROM cards */"""
)
def search_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item asks with its words and with the vector of its number; cards have the vector of their document."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    own = e.select(F.concat(F.lit("question.d"), "vec_id").alias("stable_key"), "vector")
    asked = e.join(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id")), "vec_id").select(F.col("vec_id").alias("query_id"), "vector")
    return search(spark, cards(spark, sf_dir, "stable_key", "slug", "prompt", "text"), benchmark_queries(spark, sf_dir), own, asked)


def nearest(queries: DataFrame, corpus: DataFrame, k: int = 10, least: float = -1.0) -> DataFrame:
    """query_id, vec_id, similarity, rank: exact cosine top k of a query set against all vectors, each made of length 1 once; queries meet the corpus in blocks, and of each block only the k best go on."""
    pairs = nearest_pairs(queries.select(F.col("query_id").alias("q"), F.col("q").alias("v")), corpus.select("vec_id", F.col("embedding").alias("w")), least, ("q", "vec_id"), k, "vec_id")
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 9)), "vec_id")
    return pairs.withColumnRenamed("q", "query_id").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


@register(
    """WITH p AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))) AS s
      FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id) AS rank FROM p)
    SELECT query_id, vec_id, round(s, 6) AS similarity, rank::INT AS rank FROM r WHERE rank <= 10""",
    cards=False,
)
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 100 against all."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return nearest(q, e).select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


@register(
    """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), x AS (SELECT * FROM e WHERE vec_id % 10 = 0),
    p AS (SELECT t.vec_id AS target, x.label AS capability, max(list_dot_product(t.v, x.v) / (sqrt(list_dot_product(t.v, t.v)) * sqrt(list_dot_product(x.v, x.v)))) AS s FROM e t JOIN x ON t.vec_id % 10 <> 0 GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY round(s, 9) DESC, capability) AS rank FROM p WHERE s >= 0.25)
    SELECT target, capability, round(s, 6) AS similarity, rank::INT AS rank FROM r WHERE rank <= 3""",
    cards=False,
)
def neighbor_topk(spark: SparkSession, sf_dir: str, least: float = 0.25) -> DataFrame:
    """Capability proposals: the best exemplar of each capability for each target, three at most."""
    e = table(spark, sf_dir, "embeddings")
    x = e.filter("vec_id % 10 = 0").select(F.col("label").alias("capability"), F.col("embedding").alias("v"))
    pairs = nearest_of_groups(x, e.filter("vec_id % 10 <> 0").select(F.col("vec_id").alias("target"), F.col("embedding").alias("w")), "capability", least)
    best = pairs.groupBy("target", "capability").agg(F.max("similarity").alias("s"))
    w = Window.partitionBy("target").orderBy(F.desc(F.round("s", 9)), "capability")
    return best.withColumn("rank", F.row_number().over(w)).filter("rank <= 3").select("target", "capability", F.round("s", 6).alias("similarity"), "rank")

"""Catalog, release manifest, facets, quality rules and locale coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..operators.manifests import digest
from ..sources.cards import cards, html_sections, table
from .registry import register


@register("SELECT stable_key, locale, topic, level, content_hash FROM cards WHERE content_kind = 'production' AND locale = 'en' ORDER BY stable_key LIMIT 100 OFFSET 50")
def catalog_page(spark: SparkSession, sf_dir: str, offset: int = 50, limit: int = 100) -> DataFrame:
    c = cards(spark, sf_dir, "stable_key", "locale", "topic", "level", "content_hash", "content_kind").filter("content_kind = 'production' AND locale = 'en'").select("stable_key", "locale", "topic", "level", "content_hash")
    return c.orderBy("stable_key").offset(max(offset, 0)).limit(min(limit, 2000))


@register("SELECT topic, string_agg(DISTINCT locale, ',' ORDER BY locale) AS locales, count(*) AS n, count(level) AS n_leveled, max(doc_id) AS newest FROM cards GROUP BY topic")
def catalog_topics_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cards(spark, sf_dir, "doc_id", "topic", "locale", "level")
    return c.groupBy("topic").agg(F.array_join(F.array_sort(F.collect_set("locale")), ",").alias("locales"), F.count(F.lit(1)).alias("n"), F.count("level").alias("n_leveled"), F.max("doc_id").alias("newest"))


@register(
    """, l AS (SELECT ('0x' || substr(sha256(stable_key), 1, 8))::BIGINT % 4096 AS b, stable_key AS k, sha256('{"content_hash":"' || content_hash || '","stable_key":"' || stable_key || '"}') AS v FROM cards),
    d AS (SELECT sha256(string_agg(b || ':' || v, ',' ORDER BY b)) AS digest FROM (SELECT b, sha256(string_agg(v, '' ORDER BY k)) AS v FROM l GROUP BY b))
    SELECT count(*) FILTER (WHERE content_kind = 'production') AS production, count(*) FILTER (WHERE content_kind = 'fixture') AS fixtures,
    count(*) FILTER (WHERE level IS NULL) AS unclassified, count(DISTINCT topic) AS topics, count(DISTINCT locale) AS locales, (SELECT 'release-' || substr(digest, 1, 16) FROM d) AS release_id FROM cards"""
)
def release_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks and the deterministic release id: a tree of digests over all cards in order of their keys, so that no task sees them all."""
    c = cards(spark, sf_dir, "stable_key", "locale", "topic", "level", "content_kind")
    of = digest(cards(spark, sf_dir, "stable_key", "content_hash"), "stable_key").select(F.concat(F.lit("release-"), F.substring("digest", 1, 16)).alias("release_id"))
    one = c.agg(F.count_if(F.col("content_kind") == "production").alias("production"), F.count_if(F.col("content_kind") == "fixture").alias("fixtures"), F.count_if(F.col("level").isNull()).alias("unclassified"), F.count_distinct("topic").alias("topics"), F.count_distinct("locale").alias("locales"))
    return one.join(of)  # rows of one


@register(
    """SELECT facet, key, count(*) AS n FROM (SELECT unnest([{'facet': 'locale', 'key': coalesce(nullif(trim(locale), ''), 'unclassified')}, {'facet': 'topic', 'key': topic},
    {'facet': 'level', 'key': coalesce(level, 'unclassified')}, {'facet': 'kind', 'key': content_kind}], recursive := true) FROM cards) GROUP BY ALL"""
)
def facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All facets in one pass: (facet, key) pairs are exploded and counted together."""
    value = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("unclassified"))
    pairs = F.array(*[F.struct(F.lit(f).alias("facet"), value(F.col(c)).alias("key")) for f, c in (("locale", "locale"), ("topic", "topic"), ("level", "level"), ("kind", "content_kind"))])
    return cards(spark, sf_dir, "locale", "topic", "level", "content_kind").select(F.inline(pairs)).groupBy("facet", "key").agg(F.count(F.lit(1)).alias("n"))


_FIELDS = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda x: x <> '')"
_SAME = r"lower(array_to_string(list_filter(regexp_split_to_array(coalesce({0}, ''), '\s+'), lambda x: x <> ''), ' '))"
_LAST = r"trim(lower(w[-1]), ' .,!?;:()[]{}\"''«»`')".replace('\\"', '"')
_WORD_LIST = ", ".join(f"'{w}'" for w in rules.TRAILING_WORDS)
_HEADINGS = ", ".join(f"'{w}'" for w in rules.HEADINGS)
#: As a card's title the first two words of its answer, as its topic the first word of the prompt.
_RULES = rf"""r0 AS (SELECT stable_key, topic, trim(prompt) AS p, short_answer, split_part(coalesce(short_answer, ''), ' ', 1) || ' ' || split_part(coalesce(short_answer, ''), ' ', 2) AS title, split_part(prompt, ' ', 1) AS label FROM cards),
 r AS (SELECT *, {_FIELDS.format('p')} AS w, {_SAME.format('p')} AS cp, {_SAME.format('short_answer')} AS ca, {_SAME.format('title')} AS ct, {_SAME.format('label')} AS cl, regexp_matches(p, '[?？]') AS asks FROM r0),
 x AS (SELECT stable_key, topic, CASE WHEN p = '' THEN 'empty_prompt' ELSE concat_ws(',', CASE WHEN ca <> '' AND cp = ca THEN 'prompt_equals_answer' END,
   CASE WHEN ct <> '' AND cp = ct AND len(w) <= 2 AND NOT asks THEN 'prompt_matches_title' END, CASE WHEN cl <> '' AND cp = cl AND len(w) <= 2 AND NOT asks THEN 'prompt_matches_topic' END,
   CASE WHEN cp = '' OR ends_with(cp, '—') OR trim(cp, ' .,:;—-') = '' OR cp IN ({_HEADINGS}) THEN 'pdf_heading_prompt' END,
   CASE WHEN regexp_matches(p, '[\x{{AD}}\x{{200B}}-\x{{200D}}\x{{2060}}\x{{FFFD}}\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{{9F}}]') THEN 'pdf_artifact' END,
   CASE WHEN NOT asks AND (regexp_matches(p, '[,:;—-]$') OR (len(w) >= 2 AND NOT regexp_matches(p, '[.!?。！？]$') AND ({_LAST} IN ({_WORD_LIST}) OR ends_with(lower(p), ' у нас')))) THEN 'fragment_prompt' END,
   CASE WHEN len(w) = 1 AND NOT asks AND NOT regexp_matches(p, '[\p{{P}}\p{{S}}]') THEN 'single_token_prompt' END,
   CASE WHEN len(w) = 2 AND length(p) < 20 AND NOT asks AND NOT regexp_matches(p, '[\p{{P}}\p{{S}}]') THEN 'short_label_prompt' END) END AS codes FROM r)"""


def coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cards(spark, sf_dir, "stable_key", "topic", "prompt", "short_answer")
    word = lambda col, n: F.split_part(F.coalesce(col, F.lit("")), F.lit(" "), F.lit(n))
    title = F.concat(word("short_answer", 1), F.lit(" "), word("short_answer", 2))
    return c.select("stable_key", "topic", rules.prompt_codes(F.col("prompt"), F.col("short_answer"), title, word("prompt", 1)).alias("codes"))


@register(f", {_RULES} SELECT stable_key, codes FROM x /* FROM cards */")
def prompt_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded(spark, sf_dir).select("stable_key", F.array_join("codes", ",").alias("codes"))


@register(f", {_RULES} SELECT topic, count(*) AS n, count(*) FILTER (WHERE codes <> '') AS flagged, count(*) FILTER (WHERE regexp_matches(codes, '(^|,)(empty|prompt_|pdf_heading|single|short|fragment)')) AS shaped FROM x GROUP BY topic /* FROM cards */")
def quality_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = coded(spark, sf_dir)
    return c.groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("codes") > 0).alias("flagged"), F.count_if(F.size(rules.semantic_shape(F.col("codes"))) > 0).alias("shaped"))


@register(
    r"""WITH h AS (SELECT page_id, regexp_extract_all(html, '(?is)<h[1-6][^>]*>(.*?)</h[1-6]>', 1) AS t, regexp_matches(html, '(?i)<table') AS has_table FROM pages),
    s AS (SELECT page_id, has_table, list_transform(t, lambda x: lower(array_to_string(list_filter(regexp_split_to_array(x, '\s+'), lambda y: y <> ''), ' '))) AS t FROM h)
    SELECT page_id, len(list_filter(t, lambda x: contains(x, 'task') OR contains(x, 'practice'))) > 0 AND len(list_filter(t, lambda x: regexp_matches(x, 'follow-up|follow up|trap|common mistake|pitfall|edge case|must-say|must say|term|terminology|vocabulary'))) = 0 AS practice,
    len(list_filter(t, lambda x: regexp_matches(x, 'follow-up|follow up'))) > 0 AS follow_ups, has_table AS task FROM s""",
    cards=False,
)
def learning_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers of pages taken for cards: their headings are titles of sections, a table a task."""
    titles = F.regexp_extract_all("html", F.lit(r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]>"), F.lit(1))
    task = F.when(F.col("html").rlike("(?i)<table"), "x").otherwise("")
    payload = F.to_json(F.struct(task.alias("task"), F.transform(titles, lambda t: F.struct(t.alias("title"), F.lit("x").alias("body"))).alias("sections")))
    layers = rules.learning_layers(payload, F.array(F.lit("en")), F.lit(""), F.lit(""))
    return table(spark, sf_dir, "pages").select("page_id", layers.alias("l")).select("page_id", "l.practice", "l.follow_ups", "l.task")


@register("SELECT topic, count(*) FILTER (WHERE locale = 'en') AS en, count(*) FILTER (WHERE locale = 'fr') AS fr, max(prompt) FILTER (WHERE locale = 'en') AS en_prompt, max(prompt) FILTER (WHERE locale = 'fr') AS fr_prompt FROM cards GROUP BY topic")
def two_locale_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = cards(spark, sf_dir, "topic", "locale", "prompt").groupBy("topic").pivot("locale", ["en", "fr"]).agg(F.count(F.lit(1)).alias("n"), F.max("prompt").alias("prompt"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c[:2])
    return p.select("topic", zero("en_n"), zero("fr_n"), F.col("en_prompt"), F.col("fr_prompt"))


@register("SELECT a.topic, l.locale FROM (SELECT DISTINCT topic FROM cards) a CROSS JOIN (SELECT unnest(['de', 'en', 'es', 'fr', 'ru']) AS locale) l WHERE NOT EXISTS (SELECT 1 FROM cards c WHERE c.topic = a.topic AND c.locale = l.locale)")
def locale_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cards(spark, sf_dir, "topic", "locale")
    want = c.select("topic").distinct().withColumn("locale", F.explode(F.array(*map(F.lit, ("de", "en", "es", "fr", "ru")))))
    return want.join(c.select("topic", "locale").distinct(), ["topic", "locale"], "left_anti")


@register("SELECT stable_key, locale FROM cards c WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = c.doc_id AND len(e.embedding) = 64)")
def embedding_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").filter(F.size("embedding") == 64).select(F.col("vec_id").alias("doc_id"))
    return cards(spark, sf_dir, "doc_id", "stable_key", "locale").join(e, "doc_id", "left_anti").select("stable_key", "locale")


@register("SELECT c.stable_key, min_by(p.topic, {'a': CASE WHEN p.topic = c.topic THEN 0 ELSE 1 END, 'b': p.topic}) AS placed, count(DISTINCT p.topic) AS proposals FROM cards c JOIN (SELECT prompt, topic FROM cards) p ON p.prompt = c.prompt GROUP BY c.stable_key")
def placement_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The topic each card is placed in (its own first, then by name) of those that cards with the same prompt propose: one proposal row a prompt and topic, so that copies don't multiply."""
    c = cards(spark, sf_dir, "stable_key", "prompt", "topic")
    p = c.select("prompt", F.col("topic").alias("other")).distinct()
    j = c.select("stable_key", "prompt", "topic").join(p, "prompt")
    return j.groupBy("stable_key").agg(F.min_by("other", F.struct((F.col("other") != F.col("topic")).cast("int"), "other")).alias("placed"), F.count_distinct("other").alias("proposals"))


@register(
    r"""SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title, len(regexp_extract_all(html, '<a ')) AS n_links FROM pages""", cards=False
)
def html_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_sections(table(spark, sf_dir, "pages")).select("page_id", "title", F.col("n_links").cast("long").alias("n_links"))


@register("SELECT source, n_chars AS p95 FROM (SELECT source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents) WHERE r = ceil(0.95 * n)", cards=False)
def nearest_rank_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By a histogram of (source, length): what is ordered in a task is the distinct lengths of a source, however many rows it has."""
    h = table(spark, sf_dir, "documents").groupBy("source", "n_chars").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("source")
    r = h.withColumn("upto", F.sum("n").over(w.orderBy("n_chars"))).withColumn("all", F.sum("n").over(w)).filter("upto >= ceil(0.95 * all)")
    return r.groupBy("source").agg(F.min("n_chars").alias("p95"))

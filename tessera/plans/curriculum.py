"""Registered queries of taxonomy, manifests, releases, edges, cards as files and writes, over stand-ins from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import embedding, rules, taxonomy
from ..operators import graph, manifests, review, state
from ..sources import markdown
from ..sources.cards import cards, table
from .graphs import _PROPOSED, proposed
from .registry import register


def _values(table_: dict[str, str]) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return "(VALUES " + ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in table_.items()) + ")"


# Labels that parts stand for, by their number: known ones, aliases, unknown ones and blanks.
_PATHS = ("Go", " node.js ", "path.python", "Cobol", "", "algorithms", "Behavioral", "java + spring")
_DOMAINS = ("runtime", "HTTP / API", "domain.testing", "stage.runtime", "", "algorithms", "Alchemy")
_CAPABILITIES = ("", "capability.runtime.garbage-collection", "capability.runtime.node-memory-004", "Not a key", "capability.http-api.caching")
_STATES = ("", "Accepted", "rejected", "maybe")


def _nth(values: tuple[str, ...], at: str) -> F.Column:
    return F.get(F.array(*map(F.lit, values)), F.expr(at).cast("int"))


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


@register(
    f"""WITH i AS (SELECT p_partkey, {_list(_PATHS)}[p_partkey % 8 + 1] AS path, {_list(_DOMAINS)}[p_partkey // 8 % 7 + 1] AS domain, {_list(_CAPABILITIES)}[p_partkey // 56 % 5 + 1] AS cap, {_list(_STATES)}[p_partkey // 3 % 4 + 1] AS st FROM part),
    r AS (SELECT i.*, coalesce(pa.col1, pk.col0) AS pkey, coalesce(da.col1, dk.col0) AS dkey, lower(trim(cap)) AS c, coalesce(ca.col1, lower(trim(cap))) AS ckey, CASE WHEN trim(st) = '' THEN 'proposed' ELSE lower(st) END AS s FROM i
      LEFT JOIN {_values(taxonomy.PATH_ALIASES)} pa ON pa.col0 = lower(trim(path)) LEFT JOIN {_values(taxonomy.PATHS)} pk ON pk.col0 = lower(trim(path))
      LEFT JOIN {_values(taxonomy.DOMAIN_ALIASES)} da ON da.col0 = lower(trim(domain)) LEFT JOIN {_values(taxonomy.DOMAINS)} dk ON dk.col0 = lower(trim(domain))
      LEFT JOIN {_values(taxonomy.CAPABILITY_ALIASES)} ca ON ca.col0 = lower(trim(cap))),
    m AS (SELECT r.*, coalesce(cd.col1, 'domain.' || split_part(c, '.', 2)) AS cdom FROM r LEFT JOIN {_values(taxonomy.CAPABILITY_DOMAINS)} cd ON cd.col0 = ckey),
    e AS (SELECT *, path <> '' OR domain <> '' OR cap <> '' AS given, CASE WHEN trim(path) <> '' AND pkey IS NULL THEN 'unknown_path' WHEN trim(domain) <> '' AND dkey IS NULL THEN 'unknown_domain'
      WHEN pkey IS NOT NULL AND dkey IS NOT NULL AND ((pkey = 'path.algorithms') <> (dkey = 'domain.algorithms') OR (pkey = 'path.behavioral') <> (dkey = 'domain.behavioral')) THEN 'path_domain_mismatch'
      WHEN cap <> '' AND (pkey IS NULL OR dkey IS NULL) THEN 'capability_needs_path_and_domain' WHEN cap <> '' AND NOT starts_with(c, 'capability.') THEN 'invalid_capability' WHEN cap <> '' AND cdom <> dkey THEN 'capability_outside_domain'
      WHEN (path <> '' OR domain <> '' OR cap <> '') AND s NOT IN ('proposed', 'accepted', 'rejected') THEN 'invalid_state' END AS error FROM m)
    SELECT p_partkey, error, CASE WHEN error IS NULL AND given THEN '{taxonomy.PROGRAM}' END AS program_key, CASE WHEN error IS NULL THEN pkey END AS path_key, CASE WHEN error IS NULL THEN dkey END AS domain_key,
      CASE WHEN error IS NULL AND cap <> '' THEN ckey END AS capability_key, CASE WHEN error IS NULL AND given THEN s END AS mapping_state FROM e""",
    cards=False,
)
def taxonomy_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    place = taxonomy.resolve_placement(F.lit(""), _nth(_PATHS, "p_partkey % 8"), _nth(_DOMAINS, "floor(p_partkey / 8) % 7"), _nth(_CAPABILITIES, "floor(p_partkey / 56) % 5"), _nth(_STATES, "floor(p_partkey / 3) % 4"))
    return p.select("p_partkey", place.alias("p")).select("p_partkey", *[f"p.{c}" for c in ("error", "program_key", "path_key", "domain_key", "capability_key", "mapping_state")])


_TITLES = "(SELECT unnest([" + ", ".join("'" + t.replace("'", "''") + "'" for t in taxonomy.TOPICS) + "]) AS title)"


@register(
    f"""SELECT t.*, (SELECT count(*) FROM documents d WHERE 'topic.' || lower(d.source) = t.key) AS cards FROM (SELECT 'topic' AS kind, 'topic.' || trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-') AS key, title FROM {_TITLES}
    UNION ALL SELECT 'program', '{taxonomy.PROGRAM}', '{taxonomy.PROGRAM_TITLE}' UNION ALL SELECT 'path', col0, col1 FROM {_values(taxonomy.PATHS)} UNION ALL SELECT 'domain', col0, col1 FROM {_values(taxonomy.DOMAINS)}) t""",
    cards=False,
)
def taxonomy_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards_ = cards(spark, sf_dir, "doc_id", "topic").groupBy(F.col("topic").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return taxonomy.registry(spark).join(cards_, "key", "left").select("kind", "key", "title", F.coalesce("n", F.lit(0)).alias("cards"))


_UUID = "substr(content_hash, 1, 8) || '-' || substr(content_hash, 9, 4) || '-' || substr(content_hash, 13, 4) || '-' || substr(content_hash, 17, 4) || '-' || substr(content_hash, 21, 12)"


def pinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards with a revision id made of their hash."""
    c = cards(spark, sf_dir, "doc_id", "stable_key", "content_hash", "topic", "locale")
    return c.withColumn("revision_id", F.expr(_UUID))


@register(
    f""", m AS (SELECT doc_id, stable_key, content_hash, {_UUID} AS rev FROM cards),
    e AS (SELECT *, CASE WHEN doc_id % 13 = 0 THEN 'path.go' ELSE '' END AS path, CASE WHEN doc_id % 26 = 0 THEN 'domain.runtime' ELSE '' END AS domain, CASE WHEN doc_id % 17 = 0 THEN 'x' ELSE rev END AS r, CASE WHEN doc_id % 19 = 0 THEN 'zz' ELSE content_hash END AS h FROM m),
    x AS (SELECT *, CASE WHEN path <> '' OR domain <> '' THEN 'proposed' ELSE 'unmapped' END AS st FROM e)
    SELECT stable_key, st AS mapping_state, CASE WHEN r = 'x' THEN 'revision_id' WHEN h = 'zz' THEN 'content_hash' WHEN st = 'proposed' AND (path = '' OR domain = '') THEN 'incomplete_placement' END AS problem FROM x /* FROM cards */"""
)
def mapping_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = pinned(spark, sf_dir)
    d = F.col("doc_id")
    e = c.select(
        "stable_key", F.when(d % 17 == 0, "x").otherwise(F.col("revision_id")).alias("revision_id"), F.when(d % 19 == 0, "zz").otherwise(F.col("content_hash")).alias("content_hash"), F.lit("").alias("program_key"),
        F.when(d % 13 == 0, " path.go ").otherwise("").alias("path_key"), F.when(d % 26 == 0, "domain.runtime").otherwise("").alias("domain_key"), F.lit("").alias("capability_key"), F.lit("").alias("mapping_state"), F.lit("").alias("mapping_version"), F.lit("").alias("source"),
    )
    return manifests.normal_mapping(e, "editorial").select("stable_key", "mapping_state", "problem")


@register(
    """, s AS (SELECT doc_id, content_hash FROM cards WHERE doc_id % 5 <> 0), c AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN sha256(content_hash) ELSE content_hash END AS content_hash FROM cards WHERE doc_id % 3 <> 0),
    j AS (SELECT s.doc_id AS a, c.doc_id AS b, s.content_hash AS x, c.content_hash AS y FROM s FULL JOIN c ON s.doc_id = c.doc_id)
    SELECT count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL AND x = y) AS covered, count(*) FILTER (WHERE a IS NULL) AS missing, count(*) FILTER (WHERE b IS NULL) AS extra, count(*) FILTER (WHERE x <> y) AS stale_revision, count(*) FILTER (WHERE x <> y) AS stale_hash, true AS blocked FROM j /* FROM cards */"""
)
def mapping_release_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest lacks every fifth card; of the current ones every third is gone and every seventh has changed."""
    c = pinned(spark, sf_dir).withColumn("content_hash", F.when(F.col("doc_id") % 7 == 0, F.sha2("content_hash", 256)).otherwise(F.col("content_hash"))).withColumn("revision_id", F.expr(_UUID))
    return manifests.mapping_report(manifests.unmapped(pinned(spark, sf_dir).filter("doc_id % 5 <> 0")), c.filter("doc_id % 3 <> 0"))


_TOPIC_PATH = "'path.' || substr(topic, 7)"


def _bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every card: two of three have a capability by their locale, of which Spanish is not in the registry; every tenth has an accepted proposal."""
    c = pinned(spark, sf_dir)
    path = F.expr(_TOPIC_PATH)
    own = c.select(*manifests.PINS, path.alias("path_key"), F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("capability.locale."), "locale")).alias("capability_key"))
    registry = spark.createDataFrame([(f"capability.locale.{x}",) for x in ("en", "de", "fr")], "key string")
    p = c.filter("doc_id % 10 = 0").select("stable_key", "revision_id", path.alias("path_key"), F.lit("capability.locale.en").alias("capability_key"), F.lit("recall").alias("role"), F.lit("review").alias("provenance"), F.lit(0.9).alias("confidence"))
    return manifests.generated_bindings(own, registry, p, spark.createDataFrame([], "alias string, key string"))


_BOUND = f"""b AS (SELECT stable_key, doc_id, topic, locale, {_TOPIC_PATH} AS path, doc_id % 3 <> 0 AND locale IN ('en', 'de', 'fr') AS own, doc_id % 10 = 0 AS more, doc_id % 3 = 0 OR locale IS NULL AS theory FROM cards)"""


@register(
    f""", {_BOUND} SELECT CASE WHEN own OR more THEN 'bound' WHEN theory THEN 'theory_only' ELSE 'needs_new_capability' END AS disposition, count(*) AS n, sum(own::INT + more::INT)::BIGINT AS bindings FROM b GROUP BY 1 /* FROM cards */"""
)
def binding_dispositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = manifests.normal_bindings(_bindings(spark, sf_dir))
    return e.filter("problem is null").groupBy("disposition").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("bindings")).alias("bindings"))


@register(
    f""", {_BOUND}, x AS (SELECT stable_key, path, 'capability.locale.' || locale AS cap, 'p' AS role FROM b WHERE own UNION ALL SELECT stable_key, path, 'capability.locale.en', 's' FROM b WHERE more),
    t AS (SELECT DISTINCT path, 'capability.locale.en' AS cap FROM b)
    SELECT t.path AS path_key, count(DISTINCT CASE WHEN role = 'p' THEN stable_key END) AS primary_questions, count(DISTINCT CASE WHEN role = 's' THEN stable_key END) AS supporting_prompts,
      count(DISTINCT CASE WHEN role = 'p' THEN stable_key END) >= 5 AND count(DISTINCT CASE WHEN role = 's' THEN stable_key END) >= 2 AS ready FROM t LEFT JOIN x ON x.path = t.path AND x.cap = t.cap GROUP BY t.path /* FROM cards */"""
)
def coverage_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A target for English in the path of every topic: five primary questions and two prompts."""
    e = _bindings(spark, sf_dir)
    ledger = e.select(*manifests.PINS, F.when(F.col("disposition") == "bound", "core").otherwise("supplemental").alias("disposition"), F.lit("all").alias("rationale"))
    paths = cards(spark, sf_dir, "topic").distinct().select(F.expr(_TOPIC_PATH).alias("path_key"))
    targets = paths.select("path_key", F.lit("capability.locale.en").alias("capability_key"), F.lit(True).alias("mandatory"), F.lit(5).alias("minimum_primary_questions"), F.lit(2).alias("minimum_supporting_prompts"), F.lit("all").alias("rationale"))
    out, _ = manifests.coverage_report(manifests.normal_targets(targets), manifests.normal_ledger(ledger), e)
    return out.select("path_key", "primary_questions", "supporting_prompts", "ready")


@register(
    """, p AS (SELECT stable_key, topic, CASE WHEN doc_id % 4 = 0 THEN 'accepted' WHEN doc_id % 9 = 0 THEN 'rejected' ELSE 'proposed' END AS decision FROM cards WHERE doc_id % 21 <> 0
      UNION ALL SELECT stable_key, 'topic.other', 'proposed' FROM cards WHERE doc_id % 50 = 0),
    g AS (SELECT c.stable_key, count(p.topic) AS n, min(decision) AS d FROM cards c LEFT JOIN p USING (stable_key) WHERE content_kind = 'production' GROUP BY 1)
    SELECT count(*) AS eligible, count(*) FILTER (WHERE n = 0) AS missing, count(*) FILTER (WHERE n > 1) AS multiple, 0::BIGINT AS without_topic, count(*) FILTER (WHERE n = 1 AND d = 'rejected') AS undecided, count(*) FILTER (WHERE n = 1 AND d = 'proposed') AS proposed,
      count(*) FILTER (WHERE n = 1 AND d = 'accepted') AS accepted, true AS blocked FROM g /* FROM cards */"""
)
def placement_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cards(spark, sf_dir, "doc_id", "stable_key", "topic", "content_kind")
    decision = F.when(F.col("doc_id") % 4 == 0, "accepted").when(F.col("doc_id") % 9 == 0, "rejected").otherwise("proposed")
    p = c.filter("doc_id % 21 <> 0").select("stable_key", F.col("topic").alias("topic_key"), decision.alias("decision"))
    p = p.union(c.filter("doc_id % 50 = 0").select("stable_key", F.lit("topic.other"), F.lit("proposed")))
    return manifests.placement_report(c.filter("content_kind = 'production'"), p)


_STATUS = "CASE WHEN id % 4 = 0 THEN 'accepted' ELSE 'proposed' END"


@register(
    f"""WITH RECURSIVE {_PROPOSED}, k AS (SELECT *, {_STATUS} AS status FROM e WHERE kind IN ('related', 'prerequisite', 'follow_up')),
    a AS (SELECT DISTINCT src, dst FROM k WHERE status = 'accepted' AND kind = 'prerequisite'), w AS (SELECT DISTINCT src, dst FROM k WHERE id % 3 = 0 AND kind = 'prerequisite' AND status <> 'accepted'),
    r AS (SELECT w.dst AS start, a.dst AS node FROM w JOIN a ON a.src = w.dst UNION SELECT r.start, a.dst FROM r JOIN a ON a.src = r.node),
    d AS (SELECT k.*, CASE WHEN k.id % 3 = 0 THEN CASE WHEN status = 'accepted' THEN 'noop' WHEN confidence = 1 AND rationale = '' AND k.id % 6 <> 0 THEN 'needs_evidence' WHEN rationale = '' AND k.id % 6 <> 0 THEN 'needs_rationale'
      WHEN kind = 'prerequisite' AND (src = dst OR EXISTS (SELECT 1 FROM r WHERE r.start = k.dst AND r.node = k.src)) THEN 'cycle' ELSE 'ok' END END AS result FROM k)
    SELECT id, result, CASE WHEN result = 'ok' THEN 'accepted' ELSE status END AS status FROM d""",
    cards=False,
)
def edge_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third proposal is accepted, with a reviewer's rationale for every sixth."""
    from .lifecycle import with_checkpoints

    with_checkpoints(spark)
    p = proposed(spark, sf_dir).filter(F.col("kind").isin("related", "prerequisite", "follow_up")).withColumn("status", F.expr(_STATUS))
    d = p.filter("id % 3 = 0").select("id", F.lit("accepted").alias("decision"), F.when(F.col("id") % 6 == 0, "seen").otherwise("").alias("reviewer_rationale"))
    return graph.decided_edges(p, d).select("id", "result", "status")


@register(
    f"""WITH RECURSIVE {_PROPOSED}, a AS (SELECT * FROM e WHERE kind IN ('related', 'follow_up', 'prerequisite') AND {_STATUS} = 'accepted'),
    r AS (SELECT DISTINCT src, dst FROM a WHERE kind = 'prerequisite' UNION SELECT r.src, p.dst FROM r JOIN a p ON p.src = r.dst AND p.kind = 'prerequisite'), y AS (SELECT count(DISTINCT src) AS cycles FROM r WHERE src = dst), j AS (SELECT a.*, src::INT % 10 AS s, dst::INT % 10 AS d FROM a)
    SELECT count(*) AS accepted, count(*) FILTER (WHERE s = 3 OR d = 3 OR src::INT > 5000) AS stale, count(*) FILTER (WHERE s = 1 OR d = 1) AS archived_targets, count(*) FILTER (WHERE s IN (1, 2) OR d IN (1, 2)) AS invalid_targets,
      coalesce(sum((rationale = '')::INT + (confidence = 1 AND rationale = '')::INT), 0)::BIGINT AS evidence_gaps, count(*) FILTER (WHERE contains(lower(source), 'smoke')) AS test_provenance, (SELECT cycles FROM y) AS cycles, count(*) FILTER (WHERE s IN (1, 2, 3) OR d IN (1, 2, 3) OR src::INT > 5000 OR rationale = '' OR contains(lower(source), 'smoke')) > 0 OR (SELECT cycles FROM y) > 0 AS blocked FROM j""",
    cards=False,
)
def graph_release_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users stand for cards: by the last digit of their number archived (1), in draft (2) or with a later revision (3)."""
    from .lifecycle import with_checkpoints

    with_checkpoints(spark)
    p = proposed(spark, sf_dir).filter(F.col("kind").isin("related", "follow_up", "prerequisite")).withColumn("status", F.expr(_STATUS))
    p = p.select("*", F.lit("r1").alias("src_revision"), F.lit("r1").alias("dst_revision"), F.lit("editor").alias("decided_by"))
    keys = p.select(F.col("src").alias("key")).union(p.select("dst")).distinct()
    d = F.col("key").cast("int") % 10
    cards_ = keys.select("key", F.when(d == 1, "archived").when(d == 2, "draft").otherwise("published").alias("status"), F.when((d == 3) | (F.col("key").cast("int") > 5000), "r2").otherwise("r1").alias("revision"))
    return graph.release_gates(p, cards_).select("accepted", "stale", "archived_targets", "invalid_targets", "evidence_gaps", "test_provenance", "cycles", "blocked")


@register(
    """, q AS (SELECT doc_id, stable_key, content_hash, CASE WHEN doc_id % 2 = 0 THEN 'published' ELSE 'draft' END AS status FROM cards WHERE doc_id % 5 <> 0),
    c AS (SELECT doc_id, stable_key, CASE WHEN doc_id % 7 = 0 THEN 'changed' ELSE content_hash END AS h, doc_id % 3 = 0 AS pub FROM cards WHERE doc_id % 4 <> 0)
    SELECT coalesce(q.stable_key, c.stable_key) AS stable_key, CASE WHEN c.stable_key IS NULL THEN q.status WHEN q.status = 'published' OR pub THEN 'published' ELSE 'draft' END AS status, CASE WHEN q.stable_key IS NOT NULL AND h = 'changed' THEN 2 ELSE 1 END AS revision_no,
      CASE WHEN c.stable_key IS NULL THEN 'kept' WHEN q.stable_key IS NULL THEN 'created' WHEN h = 'changed' THEN 'updated' WHEN pub AND q.status <> 'published' THEN 'published' ELSE 'unchanged' END AS action FROM q FULL JOIN c USING (stable_key) /* FROM cards */"""
)
def card_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An import over what is there: every fifth card is new, every seventh changed, every third published with it."""
    c = cards(spark, sf_dir, "doc_id", "stable_key", "content_hash")
    there = c.filter("doc_id % 5 <> 0")
    q = there.select("stable_key", F.when(F.col("doc_id") % 2 == 0, "published").otherwise("draft").alias("status"), F.lit(1).alias("revision_no"))
    r = there.select("stable_key", F.lit(1).alias("revision_no"), "content_hash")
    new = c.filter("doc_id % 4 <> 0").select("stable_key", F.when(F.col("doc_id") % 7 == 0, "changed").otherwise(F.col("content_hash")).alias("content_hash"), (F.col("doc_id") % 3 == 0).alias("publish"))
    return state.write_cards(q, r, new)[0]


@register(
    """, l AS (SELECT stable_key, prompt, coalesce(short_answer, '') AS a, doc_id FROM cards)
    SELECT stable_key, CASE WHEN doc_id % 3 = 0 THEN CASE WHEN trim(prompt) <> '' THEN prompt ELSE '' END ELSE prompt END AS prompt, CASE WHEN doc_id % 3 = 0 AND trim(prompt) <> '' THEN CASE WHEN a = 'same' THEN 'unchanged' ELSE 'updated' END WHEN a = 'same' THEN 'unchanged' ELSE 'updated' END AS action FROM l /* FROM cards */"""
)
def locale_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third new Russian prompt is blank and must not take the place of the one that is there; all answers change."""
    c = cards(spark, sf_dir, "doc_id", "stable_key", "prompt", "short_answer")
    old = c.select("stable_key", F.lit("ru").alias("locale"), "prompt", F.coalesce("short_answer", F.lit("")).alias("short_answer"))
    new = c.select("stable_key", F.lit("ru").alias("locale"), F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("prompt")).alias("prompt"), F.lit("same").alias("short_answer"))
    return state.upsert_locales(old, new).select("stable_key", "prompt", "action")


@register(
    """, c AS (SELECT doc_id, stable_key, topic, trim(regexp_replace(prompt, '[^A-Za-z ]+', '', 'g')) AS title, coalesce(short_answer, '') AS answer FROM cards),
    d AS (SELECT doc_id, 'question.d' || doc_id AS stable_key, CASE WHEN title = '' THEN 'untitled' ELSE title END AS title, topic, trim(answer) AS answer FROM c)
    SELECT stable_key, title, topic, answer, doc_id % 4 = 0 AS has_task, CASE WHEN doc_id % 4 = 0 THEN 3 ELSE 1 END AS n_sections FROM d /* FROM cards */"""
)
def card_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards written as Markdown and parsed again: a round trip; every fourth with a task."""
    c = cards(spark, sf_dir, "doc_id", "topic", "prompt", "short_answer")
    title = F.trim(F.regexp_replace("prompt", "[^A-Za-z ]+", ""))
    one = lambda t, b: F.struct(F.lit(t).alias("title"), b.alias("body"))
    answer = one("Answer", F.coalesce("short_answer", F.lit("")))
    sections = F.when(F.col("doc_id") % 4 == 0, F.array(answer, one("Task", F.lit("Write it.")), one("Solution", F.lit("```\n## done\n```")))).otherwise(F.array(answer))
    meta = F.create_map(F.lit("ID"), F.concat(F.lit("d"), "doc_id"), F.lit("Topic"), F.col("topic"), F.lit("Track"), F.lit("t"))
    files = c.select(F.col("doc_id").cast("string").alias("ref"), markdown.markdown_of(F.when(title == "", "untitled").otherwise(title), meta, sections).alias("body"))
    return markdown.parsed(files).select("stable_key", "title", "topic", markdown.body_of(F.col("sections"), "Answer").alias("answer"), F.col("task").isNotNull().alias("has_task"), F.size("sections").alias("n_sections"))


@register(
    r"""SELECT doc_id, (('0x' || substr(h, 1, 8))::BIGINT % 1024)::INT AS at, round(sum(CASE WHEN ('0x' || substr(h, 11, 2))::BIGINT % 2 = 1 THEN -1 ELSE 1 END * (1 + (('0x' || substr(h, 9, 2))::BIGINT % 7) / 7.0::DOUBLE)), 6) AS x
    FROM (SELECT doc_id, sha256(w) AS h FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(prompt), '[^\p{L}\p{N}]+')) AS w FROM cards) WHERE w <> '') GROUP BY ALL HAVING abs(sum(CASE WHEN ('0x' || substr(h, 11, 2))::BIGINT % 2 = 1 THEN -1 ELSE 1 END * (1 + (('0x' || substr(h, 9, 2))::BIGINT % 7) / 7.0::DOUBLE))) > 1e-12"""
)
def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hashed vectors of all prompts, before they are made of length 1."""
    s = embedding.sparse(cards(spark, sf_dir, "doc_id", "prompt"), "doc_id", "prompt", raw=True)
    return s.select("doc_id", "at", F.round("x", 6).alias("x"))


@register(
    """, p AS (SELECT doc_id, stable_key, prompt, short_answer, topic, locale FROM cards)
    SELECT locale, count(*) AS n, count(short_answer) AS answered, count(*) FILTER (WHERE trim(prompt) = '' OR trim(prompt) = trim(short_answer)) AS degenerate, round(count(short_answer) / count(*), 6) AS coverage FROM p GROUP BY locale /* FROM cards */"""
)
def translation_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cards(spark, sf_dir, "prompt", "short_answer", "locale")
    g = c.groupBy("locale").agg(F.count(F.lit(1)).alias("n"), F.count("short_answer").alias("answered"), F.count_if(rules.degenerate(F.col("prompt"), F.col("short_answer"))).alias("degenerate"))
    return g.withColumn("coverage", F.round(F.col("answered") / F.col("n"), 6))


@register(
    "SELECT count(*) FILTER (WHERE event_id % 5 <> 0) AS outbox_pending, (SELECT count(*) FROM documents d WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id)) AS locales_without_embedding FROM events", cards=False
)
def index_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.outbox import freshness
    from .lifecycle import _outbox

    have = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return freshness(_outbox(spark, sf_dir), table(spark, sf_dir, "documents").select("doc_id"), have, "doc_id")


@register(
    """SELECT event_id, CASE WHEN event_type = 'view' THEN 'index' WHEN json_extract_string(props, '$.k') IS NOT NULL AND event_type IN ('click', 'purchase') THEN 'payload' WHEN event_type IN ('signup', 'scroll', 'login', 'error', 'logout') THEN 'skip' ELSE 'fail' END AS route FROM events""",
    cards=False,
)
def event_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.outbox import route

    e = table(spark, sf_dir, "events")
    known = ("signup", "scroll", "login", "error", "logout")
    return e.select("event_id", route(F.col("event_type"), F.when(F.col("event_type").isin("click", "purchase"), F.col("props")), "k", ("view",), known).alias("route"))


@register(
    """, s AS (SELECT doc_id, stable_key FROM cards WHERE doc_id % 100 = 0), k AS (SELECT s.doc_id, count(*) FILTER (WHERE o.doc_id % 4 = 0) AS n_merge, count(*) FILTER (WHERE o.doc_id % 4 IN (1, 2)) AS n_open, count(o.doc_id) AS n FROM s LEFT JOIN cards o ON o.doc_id > s.doc_id AND o.doc_id <= s.doc_id + s.doc_id // 100 % 4 GROUP BY 1)
    SELECT doc_id AS stage_id, n AS candidates, n_open AS open, CASE WHEN n_merge + n_open > 0 THEN 'blocked' ELSE 'cleared' END AS status FROM k /* FROM cards */"""
)
def review_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages of every hundredth card; the next cards stand for its candidates."""
    c = cards(spark, sf_dir, "doc_id")
    s = c.filter("doc_id % 100 = 0").select(F.col("doc_id").alias("stage_id"), F.lit("staged").alias("status"))
    n = F.floor(F.col("stage_id") / 100) % 4
    near = s.select("stage_id", F.explode(F.filter(F.array(*[F.lit(i) for i in range(1, 4)]), lambda i: i <= n)).alias("i")).select("stage_id", (F.col("stage_id") + F.col("i")).alias("doc_id")).join(c, "doc_id")
    d = F.col("doc_id") % 4
    return review.stage_status(s, near.select("stage_id", F.when(d == 0, "merge").when(d.isin(1, 2), "open").otherwise("keep_separate").alias("decision"))).select("stage_id", "candidates", "open", "status")

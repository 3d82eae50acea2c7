"""The guards of the content tables as constraints, and what breaks them in the shop's tables, which stand in for these.

The stand-ins are SQL that Spark and DuckDB both read, so that guards and oracle see the same rows; the guards themselves are declared once here and written a second time, row by row, as SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.constraints import Reference, Rules, beyond, empty, one_of, unlike, violations
from ..operators.graph import KINDS, cyclic_nodes
from ..sources.cards import table
from .registry import register

REVISION = ("revisions", ("id",))

RULES = [
    Rules("locales", "id", guards={"search_document": [("stale", "search_document IS DISTINCT FROM concat_ws(' ', prompt, short_answer, explanation)")]}),
    Rules(
        "edge_proposals",
        "id",
        (Reference(("src",), *REVISION, {"src_workspace": "workspace"}), Reference(("dst",), *REVISION, {"dst_workspace": "workspace"})),
        {
            "edge_proposal_workspace": [("endpoint_missing", "src_workspace IS NULL OR dst_workspace IS NULL"), ("other_workspace", "workspace IS NULL OR src_workspace <> workspace OR dst_workspace <> workspace"), ("self_edge", "src = dst")],
            "edge_kind": [("unknown", one_of("kind", tuple(KINDS)))],
            "edge_confidence": [("range", beyond("confidence", 0, 1))],
            "edge_source": [("empty", empty("source"))],
        },
    ),
    Rules(
        "edge_items",
        "id",
        (
            Reference(("release",), "graph_releases", ("id",), {"release_workspace": "workspace"}),
            Reference(("src",), *REVISION, {"src_workspace": "workspace"}),
            Reference(("dst",), *REVISION, {"dst_workspace": "workspace"}),
            Reference(("proposal",), "edge_proposals", ("id",), {"proposal_src": "src", "proposal_dst": "dst"}),
        ),
        {
            "edge_release_workspace": [
                ("missing", "release_workspace IS NULL OR src_workspace IS NULL OR dst_workspace IS NULL"),
                ("other_workspace", "release_workspace <> src_workspace OR release_workspace <> dst_workspace"),
                ("other_proposal", "proposal IS NOT NULL AND (proposal_src IS NULL OR proposal_dst IS NULL OR proposal_src <> src OR proposal_dst <> dst)"),
            ]
        },
    ),
    Rules(
        "review_candidates",
        "id",
        (Reference(("stage",), "review_stages", ("id",), {"stage_workspace": "workspace"}), Reference(("related",), *REVISION, {"related_workspace": "workspace"})),
        {"review_candidate_workspace": [("missing", "stage_workspace IS NULL OR related_workspace IS NULL"), ("other_workspace", "stage_workspace <> related_workspace")]},
    ),
    Rules(
        "capability_reviews",
        "id",
        (Reference(("revision",), *REVISION, {"revision_workspace": "workspace"}),),
        {"capability_review_workspace": [("missing", "revision_workspace IS NULL"), ("other_workspace", "revision_workspace <> workspace")]},
    ),
    Rules(
        "binding_proposals",
        "id",
        (Reference(("revision",), *REVISION, {"revision_workspace": "workspace"}),),
        {"binding_proposal_workspace": [("missing", "revision_workspace IS NULL"), ("other_workspace", "revision_workspace <> workspace")], "binding_role": [("unknown", one_of("role", ("primary", "recall", "contrast")))]},
    ),
    Rules("binding_releases", "id", guards={"binding_release_id": [("pattern", unlike("release_key", "^release[.][0-9]{4}$"))]}, unique={"one_active_release": (("workspace",), "status = 'active'")}),
    Rules(
        "binding_items",
        "id",
        (Reference(("release",), "binding_releases", ("id",), {"release_workspace": "workspace"}), Reference(("revision",), *REVISION, {"revision_workspace": "workspace"})),
        {"binding_item_workspace": [("missing", "release_workspace IS NULL OR revision_workspace IS NULL"), ("other_workspace", "release_workspace <> revision_workspace")]},
    ),
    Rules(
        "alias_proposals",
        "id",
        (Reference(("workspace",), "workspaces", ("id",), {"known_workspace": "id"}), Reference(("canonical_key",), "capabilities", ("key",), {"known_key": "key"})),
        {"alias_workspace": [("workspace_missing", "known_workspace IS NULL"), ("key_missing", "known_key IS NULL")]},
    ),
    Rules(
        "coverage_releases",
        "id",
        (Reference(("binding_release",), "binding_releases", ("id",), {"b_workspace": "workspace", "b_question": "question_release", "b_registry": "registry_release"}),),
        {
            "coverage_release_pins": [("missing", "b_workspace IS NULL"), ("other_workspace", "b_workspace <> workspace"), ("other_questions", "b_question <> question_release"), ("other_registry", "b_registry <> registry_release")],
            "coverage_score": [("range", beyond("minimum_score", 9000, 10000))],
        },
    ),
    Rules(
        "classifications",
        "id",
        (
            Reference(("release",), "coverage_releases", ("id",), {"release_workspace": "workspace", "binding_release": "binding_release"}),
            Reference(("revision",), *REVISION, {"revision_workspace": "workspace", "own_key": "stable_key", "own_hash": "content_hash"}),
            Reference(("binding_release", "revision"), "binding_items", ("release", "revision"), {"bound": "revision"}),
        ),
        {
            "classification": [
                ("missing", "release_workspace IS NULL OR revision_workspace IS NULL"),
                ("other_workspace", "release_workspace <> revision_workspace"),
                ("other_identity", "own_key <> stable_key OR own_hash <> content_hash"),
                ("core_unbound", "disposition = 'core' AND bound IS NULL"),
                ("quarantined_bound", "disposition = 'quarantined' AND bound IS NOT NULL"),
            ]
        },
    ),
]

#: The stand-ins, by name.
STANDINS = {
    "workspaces": "SELECT n_nationkey AS id FROM nation",
    "revisions": "SELECT client_id AS id, nation_id AS workspace, concat('question.c', client_id) AS stable_key, md5(coalesce(name, '')) AS content_hash FROM clients",
    "locales": "SELECT client_id AS id, name AS prompt, city AS short_answer, email AS explanation, CASE WHEN client_id % 9 = 0 THEN city ELSE concat_ws(' ', name, city, email) END AS search_document FROM clients",
    "edge_proposals": "SELECT client_id AS id, nation_id AS workspace, client_id AS src, master_id AS dst, CASE WHEN segment = 'export' THEN 'linked' ELSE 'related' END AS kind, balance / 8000 AS confidence, CASE WHEN client_id % 50 = 3 THEN ' ' ELSE source END AS source FROM clients",
    "graph_releases": "SELECT vendor_id AS id, nation_id AS workspace FROM vendors",
    "edge_items": "SELECT h.change_id AS id, h.change_id % 80 AS release, CASE WHEN h.change_id % 3 > 0 THEN h.client_id END AS proposal, h.client_id AS src, CASE WHEN h.change_id % 5 = 0 THEN h.seq ELSE c.master_id END AS dst FROM client_changes h LEFT JOIN clients c ON c.client_id = h.client_id",
    "review_stages": "SELECT s.sale_id AS id, c.nation_id AS workspace FROM sales s LEFT JOIN clients c ON c.client_id = s.client_id",
    "review_candidates": "SELECT concat(coalesce(sale_id, -1), '.', coalesce(line_no, -1), '.', coalesce(item_id, -1)) AS id, sale_id AS stage, item_id AS related FROM sale_lines",
    "capability_reviews": "SELECT change_id AS id, change_id % 25 AS workspace, client_id AS revision FROM client_changes",
    "binding_proposals": "SELECT sale_id AS id, priority AS workspace, client_id AS revision, CASE WHEN status = 'paid' THEN 'primary' WHEN status = 'open' THEN 'recall' ELSE status END AS role FROM sales",
    "binding_releases": "SELECT vendor_id AS id, nation_id AS workspace, concat('release.', lpad(CAST(vendor_id AS varchar(9)), 4, '0')) AS release_key, concat('q', vendor_id % 3) AS question_release, concat('r', vendor_id % 2) AS registry_release, CASE WHEN balance > 0 THEN 'active' ELSE 'rolled_back' END AS status FROM vendors",
    "binding_items": "SELECT DISTINCT concat(coalesce(vendor_id, -1), '.', coalesce(item_id, -1)) AS id, vendor_id AS release, item_id AS revision FROM sale_lines WHERE quantity > 5",
    "capabilities": "SELECT DISTINCT brand AS key FROM items WHERE kind < 'm'",
    "alias_proposals": "SELECT item_id AS id, size AS workspace, brand AS canonical_key FROM items",
    "coverage_releases": "SELECT vendor_id AS id, CASE WHEN vendor_id % 4 = 0 THEN nation_id + 1 ELSE nation_id END AS workspace, CASE WHEN vendor_id % 7 = 0 THEN -1 ELSE vendor_id END AS binding_release, concat('q', vendor_id % 6) AS question_release, concat('r', vendor_id % 4) AS registry_release, 8990 + vendor_id AS minimum_score FROM vendors",
    "classifications": "SELECT h.change_id AS id, h.client_id % 60 AS release, h.client_id AS revision, concat('question.c', h.client_id) AS stable_key, CASE WHEN h.change_id % 6 = 0 THEN '' ELSE md5(coalesce(c.name, '')) END AS content_hash, CASE WHEN h.change_id % 2 = 0 THEN 'core' ELSE 'quarantined' END AS disposition FROM client_changes h LEFT JOIN clients c ON c.client_id = h.client_id",
}
TABLES = ("nation", "clients", "vendors", "client_changes", "sales", "sale_lines", "items")


def standins(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    own = {t: table(spark, sf_dir, t) for t in TABLES}
    # a name in braces is a DataFrame argument of spark.sql
    mark = lambda q: " ".join("{" + w + "}" if w in TABLES else w for w in q.split(" "))
    return {n: spark.sql(mark(q), **{t: own[t] for t in TABLES if "{" + t + "}" in mark(q)}) for n, q in STANDINS.items()}


def _row(name: str, guard: str, cases: str, source: str) -> str:
    return f"SELECT '{name}' AS \"table\", id::VARCHAR AS row_id, '{guard}' AS guard, code FROM (SELECT x.id, CASE {cases} END AS code FROM {source}) WHERE code IS NOT NULL"


_KINDS = ", ".join(f"'{k}'" for k in KINDS)
#: Reference by a scalar subquery: the largest where a key comes again, null where it is missing.
_WS = lambda column: f"(SELECT max(r.workspace) FROM revisions r WHERE r.id = x.{column})"
_CASE = lambda *pairs: " ".join(f"WHEN {c} THEN '{code}'" for code, c in pairs)
_ORACLE = "WITH " + ", ".join(f"{n} AS ({q})" for n, q in STANDINS.items()) + " " + " UNION ALL ".join(
    [
        _row("locales", "search_document", _CASE(("stale", "x.search_document IS DISTINCT FROM concat_ws(' ', x.prompt, x.short_answer, x.explanation)")), "locales x"),
        _row("edge_proposals", "edge_proposal_workspace", _CASE(("endpoint_missing", "x.s IS NULL OR x.d IS NULL"), ("other_workspace", "x.workspace IS NULL OR x.s <> x.workspace OR x.d <> x.workspace"), ("self_edge", "x.src = x.dst")), f"(SELECT x.*, {_WS('src')} AS s, {_WS('dst')} AS d FROM edge_proposals x) x"),
        _row("edge_proposals", "edge_kind", _CASE(("unknown", f"x.kind IS NULL OR x.kind NOT IN ({_KINDS})")), "edge_proposals x"),
        _row("edge_proposals", "edge_confidence", _CASE(("range", "NOT (x.confidence BETWEEN 0 AND 1)")), "edge_proposals x"),
        _row("edge_proposals", "edge_source", _CASE(("empty", "trim(coalesce(x.source, '')) = ''")), "edge_proposals x"),
        _row("edge_items", "edge_release_workspace", _CASE(("missing", "x.w IS NULL OR x.s IS NULL OR x.d IS NULL"), ("other_workspace", "x.w <> x.s OR x.w <> x.d"), ("other_proposal", "x.proposal IS NOT NULL AND NOT EXISTS (SELECT 1 FROM edge_proposals p WHERE p.id = x.proposal AND p.src = x.src AND p.dst = x.dst)")), f"(SELECT x.*, {_WS('src')} AS s, {_WS('dst')} AS d, (SELECT max(g.workspace) FROM graph_releases g WHERE g.id = x.release) AS w FROM edge_items x) x"),
        _row("review_candidates", "review_candidate_workspace", _CASE(("missing", "x.w IS NULL OR x.s IS NULL"), ("other_workspace", "x.w <> x.s")), f"(SELECT x.*, {_WS('related')} AS s, (SELECT max(g.workspace) FROM review_stages g WHERE g.id = x.stage) AS w FROM review_candidates x) x"),
        _row("capability_reviews", "capability_review_workspace", _CASE(("missing", "x.s IS NULL"), ("other_workspace", "x.s <> x.workspace")), f"(SELECT x.*, {_WS('revision')} AS s FROM capability_reviews x) x"),
        _row("binding_proposals", "binding_proposal_workspace", _CASE(("missing", "x.s IS NULL"), ("other_workspace", "x.s <> x.workspace")), f"(SELECT x.*, {_WS('revision')} AS s FROM binding_proposals x) x"),
        _row("binding_proposals", "binding_role", _CASE(("unknown", "coalesce(x.role, '') NOT IN ('primary', 'recall', 'contrast')")), "binding_proposals x"),
        _row("binding_releases", "binding_release_id", _CASE(("pattern", "NOT regexp_full_match(x.release_key, 'release[.][0-9]{4}')")), "binding_releases x"),
        _row("binding_releases", "one_active_release", _CASE(("not_unique", "x.status = 'active' AND (SELECT count(*) FROM binding_releases o WHERE o.status = 'active' AND o.workspace IS NOT DISTINCT FROM x.workspace) > 1")), "binding_releases x"),
        _row("binding_items", "binding_item_workspace", _CASE(("missing", "x.w IS NULL OR x.s IS NULL"), ("other_workspace", "x.w <> x.s")), f"(SELECT x.*, {_WS('revision')} AS s, (SELECT max(g.workspace) FROM binding_releases g WHERE g.id = x.release) AS w FROM binding_items x) x"),
        _row("alias_proposals", "alias_workspace", _CASE(("workspace_missing", "x.workspace IS NULL OR x.workspace NOT IN (SELECT id FROM workspaces)"), ("key_missing", "NOT EXISTS (SELECT 1 FROM capabilities c WHERE c.key = x.canonical_key)")), "alias_proposals x"),
        _row("coverage_releases", "coverage_release_pins", _CASE(("missing", "x.bw IS NULL"), ("other_workspace", "x.bw <> x.workspace"), ("other_questions", "x.bq <> x.question_release"), ("other_registry", "x.br <> x.registry_release")), "(SELECT x.*, b.workspace AS bw, b.question_release AS bq, b.registry_release AS br FROM coverage_releases x LEFT JOIN binding_releases b ON b.id = x.binding_release) x"),
        _row("coverage_releases", "coverage_score", _CASE(("range", "x.minimum_score NOT BETWEEN 9000 AND 10000")), "coverage_releases x"),
        _row("classifications", "classification", _CASE(("missing", "x.w IS NULL OR x.s IS NULL"), ("other_workspace", "x.w <> x.s"), ("other_identity", "x.k <> x.stable_key OR x.h <> x.content_hash"), ("core_unbound", "x.disposition = 'core' AND NOT x.bound"), ("quarantined_bound", "x.disposition = 'quarantined' AND x.bound")), f"(SELECT x.*, {_WS('revision')} AS s, r.stable_key AS k, r.content_hash AS h, c.workspace AS w, EXISTS (SELECT 1 FROM binding_items i WHERE i.release = c.binding_release AND i.revision = x.revision) AS bound FROM classifications x LEFT JOIN revisions r ON r.id = x.revision LEFT JOIN coverage_releases c ON c.id = x.release) x"),
    ]
)


@register(_ORACLE, cards=False)
def guard_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row of the stand-ins that breaks a guard, and how."""
    return violations(RULES, standins(spark, sf_dir))


@register("WITH RECURSIVE e AS (SELECT DISTINCT master_id AS src, client_id AS dst FROM clients WHERE master_id <> client_id), r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src) SELECT DISTINCT src AS node FROM r WHERE src = dst", cards=False)
def supersedes_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The guard of supersessions: keys on a cycle of them. A client's master stands for what supersedes it."""
    from .lifecycle import with_checkpoints

    with_checkpoints(spark)
    c = table(spark, sf_dir, "clients").filter("master_id <> client_id")
    return cyclic_nodes(c.select(F.col("master_id").alias("src"), F.col("client_id").alias("dst")))

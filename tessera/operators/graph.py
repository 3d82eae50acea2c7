"""Reachability, cycles, edge rules, releases and neighbourhoods over edge tables, by frontier joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import blank, from_test, trimmed
from ..functions.taxonomy import EDGE_KINDS

KINDS = tuple(k for k, *_ in EDGE_KINDS)
DECISIONS = ("accepted", "rejected", "superseded")


def cyclic_nodes(edges: DataFrame, rounds: int = 10_000) -> DataFrame:
    """node: those on a directed cycle of the edges (src, dst).

    Trimming takes away, again and again, nodes without an edge in or out. What is left is parted by colours: each round spreads the greatest
    name forward to a fixed point, and then, within a colour, backward from the node that has the colour's name; those reached are one strongly
    connected component and leave. Tables never grow beyond the edges; no closure of pairs is made.
    """
    e = edges.select("src", "dst").distinct().checkpoint()
    found = e.filter("src = dst").select(F.col("src").alias("node"))
    e = e.filter("src <> dst").checkpoint()
    for _ in range(rounds):
        e = _trimmed(e)
        if e.limit(1).count() == 0:
            break
        nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
        colour = _settled(nodes.withColumn("c", F.col("node")), e, "src", "dst")
        inner = e.join(colour.select(F.col("node").alias("src"), F.col("c").alias("cs")), "src").join(colour.select(F.col("node").alias("dst"), F.col("c").alias("cd")), "dst").filter("cs = cd").select("src", "dst", F.col("cs").alias("c")).checkpoint()
        part = colour.filter("node = c").select("node", "c").checkpoint()
        front = part
        while front.limit(1).count():
            step = inner.join(front.select(F.col("node").alias("dst"), "c"), ["dst", "c"]).select(F.col("src").alias("node"), "c").distinct()
            front = step.join(part, ["node", "c"], "left_anti").checkpoint()
            part = part.union(front).checkpoint()
        size = part.groupBy("c").count().filter("count > 1")
        found = found.union(part.join(size, "c").select("node")).distinct().checkpoint()
        gone = part.select("node").distinct()
        e = inner.select("src", "dst").join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").checkpoint()
    return found.distinct()


def _trimmed(e: DataFrame) -> DataFrame:
    n = e.count()
    while True:
        e = e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst").checkpoint()
        m = e.count()
        if m == n:
            return e
        n = m


def _settled(colour: DataFrame, e: DataFrame, at: str, to: str) -> DataFrame:
    """Colours spread along the edges until every node has the greatest that reaches it."""
    while True:
        told = e.join(colour.withColumnRenamed("node", at), at).groupBy(F.col(to).alias("node")).agg(F.max("c").alias("m"))
        new = colour.join(told, "node", "left").select("node", F.greatest("c", "m").alias("c"), (F.coalesce("m", "c") > F.col("c")).alias("moved")).checkpoint()
        colour = new.select("node", "c")
        if new.filter("moved").limit(1).count() == 0:
            return colour


def reachable(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """start, node: all nodes that each start (a column) reaches by one edge or more. Each round follows only what is new."""
    e = edges.select("src", "dst").distinct()
    seen = starts.select(F.col(starts.columns[0]).alias("start")).distinct().join(e.withColumnRenamed("src", "start"), "start").select("start", F.col("dst").alias("node")).distinct().checkpoint()
    front = seen
    while front.limit(1).count():
        step = front.join(e.withColumnRenamed("src", "node"), "node").select("start", F.col("dst").alias("node")).distinct()
        front = step.join(seen, ["start", "node"], "left_anti").checkpoint()
        seen = seen.union(front).checkpoint()
    return seen


def closes_cycle(accepted: DataFrame, proposed: DataFrame) -> DataFrame:
    """proposed edges (src, dst) with ``cycle``: whether src is reached from dst over the accepted edges, or the edge is a loop. Also for chains of supersession."""
    back = reachable(accepted, proposed.select("dst")).select(F.col("start").alias("dst"), F.col("node").alias("src"), F.lit(True).alias("back"))
    return proposed.join(back, ["src", "dst"], "left").withColumn("cycle", F.coalesce("back", F.lit(False)) | (F.col("src") == F.col("dst"))).drop("back")


def back_edges(edges: list[tuple[str, str]]) -> int:
    """Edges that close a cycle in a depth-first walk in order of names; for graphs of an audit, which the driver holds."""
    out: dict[str, list[str]] = {}
    for a, b in sorted(set(edges)):
        out.setdefault(a, []).append(b)
    state: dict[str, int] = {}
    n = 0
    for root in sorted(out):
        if root in state:
            continue
        state[root] = 1
        stack = [(root, iter(out[root]))]
        while stack:
            node, rest = stack[-1]
            nxt = next(rest, None)
            if nxt is None:
                state[node] = 2
                stack.pop()
            elif nxt not in state:
                state[nxt] = 1
                stack.append((nxt, iter(out.get(nxt, ()))))
            elif state[nxt] == 1:
                n += 1
    return n


def neighbourhood(edges: DataFrame, keys: DataFrame) -> DataFrame:
    """key, other, direction: edges at either end of the keys."""
    out = edges.join(keys.withColumnRenamed("key", "src"), "src").select(F.col("src").alias("key"), F.col("dst").alias("other"), F.lit("out").alias("direction"))
    into = edges.join(keys.withColumnRenamed("key", "dst"), "dst").select(F.col("dst").alias("key"), F.col("src").alias("other"), F.lit("in").alias("direction"))
    return out.union(into)


def evidence_gap(kind: Column, confidence: Column, rationale: Column, source: Column) -> Column:
    """A certain edge needs a rationale and a source."""
    return ~F.coalesce(kind.isin(*KINDS), F.lit(False)) | (F.coalesce(confidence == 1, F.lit(False)) & (blank(rationale) | blank(source)))


def edge_problem(production: Column | None = None, default_source: str = "editorial") -> Column:
    """Code of the first rule that an edge request (src, dst, kind, confidence, rationale, source) breaks. production: whether its workspace may not hold test data."""
    source = F.coalesce(F.nullif(trimmed(F.col("source")), F.lit("")), F.lit(default_source))
    out = (
        F.when(blank(F.col("src")) | blank(F.col("dst")) | (trimmed(F.col("src")) == trimmed(F.col("dst"))), "distinct_ends")
        .when(~F.coalesce(trimmed(F.col("kind")).isin(*KINDS), F.lit(False)), "unknown_kind")
        .when((F.col("confidence") < 0) | (F.col("confidence") > 1), "confidence_range")
        .when(evidence_gap(trimmed(F.col("kind")), F.col("confidence"), F.col("rationale"), source), "needs_evidence")
    )
    return out.when(production & from_test(source), "test_provenance") if production is not None else out


def decided_edges(proposals: DataFrame, decisions: DataFrame) -> DataFrame:
    """proposals (id, src, dst, kind, status, confidence, rationale, source) with decisions (id, decision, reviewer_rationale): status, rationale and ``result``:
    ok, noop, unsupported, needs_rationale, needs_evidence, cycle, or null where none is asked for. Each acceptance is held against the edges accepted before."""
    j = proposals.join(decisions, "id", "left")
    why = F.coalesce(F.nullif(trimmed(F.col("reviewer_rationale")), F.lit("")), trimmed(F.col("rationale")))
    accepts = F.col("decision") == "accepted"
    pre = F.col("kind") == "prerequisite"
    asked = j.filter(accepts & pre & (F.col("status") != "accepted")).select("src", "dst").distinct()
    loops = closes_cycle(proposals.filter((F.col("status") == "accepted") & pre).select("src", "dst"), asked)
    j = j.join(loops, ["src", "dst"], "left")
    result = (
        F.when(F.col("decision").isNull(), F.lit(None).cast("string"))
        .when(~F.col("decision").isin(*DECISIONS), "unsupported")
        .when(F.col("decision") == F.col("status"), "noop")
        .when(accepts & blank(why), "needs_rationale")
        .when(accepts & evidence_gap(F.col("kind"), F.col("confidence"), why, F.col("source")), "needs_evidence")
        .when(accepts & pre & F.coalesce("cycle", F.lit(False)), "cycle")
        .otherwise("ok")
    )
    j = j.withColumn("result", result)
    ok = F.coalesce(F.col("result") == "ok", F.lit(False))
    return j.select(*[c for c in proposals.columns if c not in ("status", "rationale")], F.when(ok, F.col("decision")).otherwise(F.col("status")).alias("status"), F.when(ok, why).otherwise(F.col("rationale")).alias("rationale"), "result")


def release_gates(proposals: DataFrame, cards: DataFrame) -> DataFrame:
    """One row: accepted edges, and how many of them are stale, archived, not published, without evidence, of test origin, and nodes on cycles of prerequisites; blocked.
    proposals: src, dst, src_revision, dst_revision, kind, status, confidence, rationale, source, decided_by; cards: key, status, revision."""
    a = proposals.filter("status = 'accepted'")
    end = lambda p: cards.select(F.col("key").alias(p), F.col("status").alias(f"{p}_status"), F.col("revision").alias(f"{p}_now"))
    j = a.join(end("src"), "src", "left").join(end("dst"), "dst", "left")
    current = F.coalesce((F.col("src_now") == F.col("src_revision")) & (F.col("dst_now") == F.col("dst_revision")), F.lit(False))
    gap = (blank(F.col("rationale")) | blank(F.col("decided_by"))).cast("int") + evidence_gap(F.col("kind"), F.col("confidence"), F.col("rationale"), F.col("source")).cast("int")
    out = j.agg(
        F.count(F.lit(1)).alias("accepted"),
        F.count_if(~current).alias("stale"),
        F.count_if((F.col("src_status") == "archived") | (F.col("dst_status") == "archived")).alias("archived_targets"),
        F.count_if(~F.coalesce((F.col("src_status") == "published") & (F.col("dst_status") == "published"), F.lit(False))).alias("invalid_targets"),
        F.coalesce(F.sum(gap), F.lit(0)).alias("evidence_gaps"),
        F.count_if(from_test(F.col("source")) | from_test(F.col("decided_by"))).alias("test_provenance"),
    )
    cycles = cyclic_nodes(a.filter("kind = 'prerequisite'")).count()
    out = out.withColumn("cycles", F.lit(cycles))
    reasons = [c for c in out.columns if c != "accepted"]
    return out.withColumn("blocked_reasons", F.array_compact(F.array(*[F.when(F.col(c) > 0, F.lit(c)) for c in reasons]))).withColumn("blocked", F.size("blocked_reasons") > 0)


def release_read(releases: DataFrame, edges: DataFrame, workspace: str, release_id: str | None = None) -> DataFrame:
    """Edges of a release of a workspace: of the active one, unless one is named."""
    r = releases.filter(F.col("workspace") == workspace)
    r = r.filter(F.col("release_id") == release_id) if release_id else r.filter("status = 'active'")
    return edges.join(r.select("release_id"), "release_id", "left_semi")


def audit(edges: DataFrame, accepted: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row: release edges (src, dst, kind) without an accepted proposal or with an end beyond the catalog (key), and accepted ones that the release lacks."""
    key = ["src", "dst", "kind"]
    known = lambda c: catalog.select(F.col("key").alias(c), F.lit(True).alias(f"{c}_known")).distinct()
    both = edges.select(*key, F.lit(True).alias("e")).join(accepted.select(*key, F.lit(True).alias("p")).distinct(), key, "full_outer").join(known("src"), "src", "left").join(known("dst"), "dst", "left")
    return both.agg(F.count("e").alias("edges"), F.count_if(F.col("p").isNull()).alias("without_proposal"), F.count_if(F.col("e").isNull()).alias("unreleased"), F.count_if(F.col("e") & (F.col("src_known").isNull() | F.col("dst_known").isNull())).alias("unknown_ends"))

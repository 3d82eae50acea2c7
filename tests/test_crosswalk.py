import pytest

from tessera.operators import crosswalk as cw

HOW = ("program.p", "v2", "registry")


@pytest.fixture
def tables(spark):
    card = "stable_key string, revision_id string, content_hash string, topics array<struct<title:string,relation:string>>"
    catalog = spark.createDataFrame(
        [("a", "r1", "h1", [("Go", "primary"), ("SQL", "secondary")]), ("b", "r2", "h2", [("SQL", "secondary")]), ("c", "r3", "h3", [("X", "secondary"), ("Go", "secondary")]), ("d", "r4", "h4", []), ("e", "r5", "h5", [("Rust", "primary")]), ("f", "r6", "h6", None)], card
    )
    old = spark.createDataFrame([("e", "r0", "h0", "program.old", "path.old", "domain.old", "accepted", "v1", "editor"), ("a", "r0", "h0", "p", "q", "r", "proposed", "v1", "editor"), ("gone", "r0", "h0", "p", "q", "r", "proposed", "v1", "editor")], cw.ENTRY)
    decisions = spark.createDataFrame([("Go", "path.go", "domain.go"), ("SQL", "path.sql", "domain.data")], "title string, path_key string, domain_key string")
    return catalog, old, decisions


def rows(df):
    return {r.stable_key: (r.mapping_state, r.revision_id, r.path_key, r.mapping_version, r.source) for r in df.collect()}


def test_propose_accept_twice(spark, tables):
    catalog, old, decisions = tables
    p = cw.propose(catalog, old, decisions, *HOW)
    assert rows(p) == {
        "a": ("proposed", "r1", "path.go", "v2", "registry"), "b": ("proposed", "r2", "path.sql", "v2", "registry"), "c": ("unmapped", "r3", None, None, "registry"), "d": ("unmapped", "r4", None, None, "registry"),
        "e": ("accepted", "r0", "path.old", "v1", "editor"), "f": ("unmapped", "r6", None, None, "registry"),
    }
    a = cw.accept(p, catalog, decisions, *HOW)
    assert {k: v[0] for k, v in rows(a).items()} == {"a": "accepted", "b": "accepted", "c": "unmapped", "d": "unmapped", "e": "accepted", "f": "unmapped"}
    assert rows(a)["e"] == rows(p)["e"]
    assert rows(cw.accept(a, catalog, decisions, *HOW)) == rows(a)
    again = cw.propose(catalog, a, decisions, *HOW)
    assert rows(again) == rows(a)
    gone = {r.stable_key: r for r in cw.accept(old, catalog, decisions, *HOW).collect()}["gone"]
    assert (gone.missing, gone.mapping_state, gone.path_key, gone.source) == (True, "unmapped", None, "editor")
    c = cw.counters(a, p).first()
    assert (c.entries, c.accepted, c.proposed, c.unmapped, c.preserved, c.by_path) == (6, 3, 0, 3, 1, {"path.go": 1, "path.sql": 1, "path.old": 1})
    assert [tuple(t) for t in c.unmapped_topics] == [("<missing topic>", 3)]


def test_unsupported_state(spark, tables):
    catalog, old, decisions = tables
    bad = spark.createDataFrame([("a", "r", "h", "p", "q", "r", "odd", "v", "s")], cw.ENTRY)
    with pytest.raises(Exception, match="unsupported state of a"):
        cw.accept(bad, catalog, decisions, *HOW).collect()

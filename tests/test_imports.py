import pytest

from tessera.operators import imports
from tessera.operators.releases import Conflict, ReleaseStore

CARD = "source_ref string, stable_key string, content_hash string, problems array<string>, en struct<prompt:string,short_answer:string,explanation:string>, ru struct<prompt:string,short_answer:string,explanation:string>"


def cards(spark, *rows):
    return spark.createDataFrame([(ref, key, h, p, (f"prompt of {key}", "a", None), (None, None, None)) for ref, key, h, p in rows], CARD)


def settled(spark, done):
    """The tables of a run without its lineage."""
    return {n: spark.createDataFrame(df.collect(), imports.TABLES[n]) for n, df in done.tables.items()}


def got(done):
    return {r.stable_key: (r.status, r.revision_no) for r in done.tables["questions"].collect()}


def actions(done):
    return {r.source_ref: (r.action, list(r.problems)) for r in done.items.collect()}


def test_runs(spark):
    one = imports.drafts(imports.empty(spark), cards(spark, ("1", "a", "h1", []), ("2", "b", "h1", []), ("3", "a", "h9", []), ("4", "c", "h1", ["short"])))
    assert got(one) == {"a": ("draft", 1), "b": ("draft", 1)}
    assert actions(one) == {"1": ("created", []), "2": ("created", []), "3": ("invalid", ["duplicate_key"]), "4": ("invalid", ["short"])}
    r = one.report("r").first()
    assert (r.files, r.invalid, r.totals) == (4, 2, {"created": 2, "invalid": 2})
    two = imports.published(settled(spark, one), cards(spark, ("1", "a", "h2", []), ("5", "d", "h1", [])))
    assert got(two) == {"a": ("published", 2), "b": ("draft", 1), "d": ("published", 1)}
    after = settled(spark, two)
    again = imports.published(after, cards(spark, ("1", "a", "h2", []), ("5", "d", "h1", [])))
    assert got(again) == got(two) and {x[0] for x in actions(again).values()} == {"unchanged"}
    assert again.tables["outbox"].count() == after["outbox"].count() == 4
    three = imports.published(after, cards(spark, ("1", "a", "h1", [])))
    assert got(three) == {"a": ("published", 1), "b": ("draft", 1), "d": ("archived", 1)}
    assert {(r.stable_key, r.prompt) for r in three.tables["locales"].collect()} == {(k, f"prompt of {k}") for k in "abd"}


def test_staged(spark):
    one = imports.published(imports.empty(spark), cards(spark, ("1", "a", "h1", [])))
    stages = spark.createDataFrame([("a", "h1", "open"), ("b", "h1", "cleared"), ("c", "h1", "blocked"), ("d", "h1", "cleared")], "stable_key string, content_hash string, status string")
    done = imports.staged(settled(spark, one), cards(spark, ("1", "a", "h1", []), ("2", "b", "h1", []), ("3", "c", "h1", []), ("4", "d", "h2", []), ("5", "e", "h1", [])), stages)
    assert actions(done) == {"1": ("unchanged", []), "2": ("created", []), "3": ("invalid", ["not_cleared"]), "4": ("invalid", ["not_cleared"]), "5": ("invalid", ["not_cleared"])}


def test_stored_runs_are_whole(spark, tmp_path):
    store = ReleaseStore(spark, str(tmp_path), "main")
    first = imports.drafts(imports.stored(store), cards(spark, ("1", "a", "h1", [])))
    seen = imports.commit(store, first, "run-1", "x", "t1").version
    mine, theirs = (imports.published(imports.stored(store), cards(spark, ("1", k, "h2", []))) for k in "ab")
    imports.commit(store, theirs, "run-2", "x", "t2", expected=seen)
    with pytest.raises(Conflict):
        imports.commit(store, mine, "run-3", "x", "t2", expected=seen)
    assert {r.stable_key: r.status for r in imports.stored(store)["questions"].collect()} == {"a": "draft", "b": "published"}
    store.roll_back("x", "t3")
    assert {r.stable_key for r in imports.stored(store)["questions"].collect()} == {"a"} and store.read("items", release_id="run-2").count() == 1


def test_import_releases(spark):
    from tessera.plans import registry

    got = {(r.version, r.release_id, r.status): r.n for r in registry.QUERIES["import_releases"](spark, "/root/testdata/sf0.001").collect()}
    assert {v: r for v, r, _ in got} == {1: "run-1", 2: "run-2", 3: "run-1", 4: "run-3"}
    assert {s: n for (v, _, s), n in got.items() if v == 1} == {s: n for (v, _, s), n in got.items() if v == 3}
    assert all(got[2, "run-2", s] > 0 for s in ("draft", "published")) and (4, "run-3", "archived") not in got

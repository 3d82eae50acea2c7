"""The walk over JSON against Python's parser, and the index of inverted lists."""

import json

from pyspark.sql import functions as F

from tessera.functions import rules, variants


def brute(x, path="$"):
    kind = {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}.get(type(x), "number")
    yield path, kind, x if kind == "string" else None
    for k, v in x.items() if isinstance(x, dict) else ():
        yield from brute(v, f"{path}.{k}")
    for v in x if isinstance(x, list) else ():
        yield from brute(v, f"{path}[]")


DOCS = ["null", "3", '"a \\"quoted\\" \\u00e9 text"', "[]", "{}", '{"b": [1, {"x": "y", "z": null}], "a": {"q": true, "n": 1.5}, "s": "t:\\n,"}', "[[[[[\"deep\"]]]]]", '{"a": "x, \\"y\\": 1", "list": ["p", "q", ["r"]]}', '{"k[{": "[[[{"}', "[" * 40 + "1" + "]" * 40]


def test_walk(spark):
    d = spark.createDataFrame([(i, x) for i, x in enumerate(DOCS)] + [(90, "no json"), (91, None), (92, ""), (93, '{"k": 1, "k": 2}'), (94, "{")], "n int, p string")
    got = {r.n: r for r in d.select("n", variants.walk(F.col("p")).alias("w"), variants.strings(F.col("p")).alias("s"), variants.canonical(F.col("p")).alias("c")).collect()}
    for i, x in enumerate(DOCS):
        want = list(brute(json.loads(x)))
        assert sorted((p, k, t if k == "string" else None) for p, k, t in got[i].w) == sorted(want, key=str) or sorted(((p, k, t if k == "string" else None) for p, k, t in got[i].w), key=str) == sorted(want, key=str)
        assert sorted(got[i].s) == sorted(t for _, k, t in want if k == "string")
        assert json.loads(got[i].c) == json.loads(x)
    assert all(got[i].w is None and got[i].s == [] and got[i].c is None for i in range(90, 95))


def test_canonical_keeps_unknown_fields(spark):
    d = spark.createDataFrame([('{"z":1,"legacy":{"b":[2,1],"a":null},"n":12345678901234567890.125}',), (' { "n" : 12345678901234567890.125 , "legacy":{"a":null,"b":[2,1]}, "z":1 } ',)], "p string")
    out = d.select(variants.canonical(F.col("p")).alias("c")).distinct().collect()
    assert [r.c for r in out] == ['{"legacy":{"a":null,"b":[2,1]},"n":12345678901234567890.125,"z":1}']


def test_too_deep(spark):
    import pytest

    d = spark.createDataFrame([("[" * 12 + "]" * 12,)], "p string")
    assert d.select(F.size(variants.walk(F.col("p"), 12))).first()[0] == 12
    with pytest.raises(Exception, match="deeper than 11"):
        d.select(variants.walk(F.col("p"), 11)).collect()


def test_layout_is_an_argument():
    assert rules.Layout("x").parts == ()


def test_census_walks_equal_texts_once(spark, tmp_path):
    """Values and rows of payloads that come again and hold a path twice; only distinct texts are walked."""
    from tessera.plans import payloads

    rows = [('{"a": [1, 2, {"b": "y"}], "c": "x"}',)] * 3 + [('{"a": [3]}',), ("no json",), (None,), ('{"a": [{"b": "q"}, {"b": null}]}',)]
    for name in ("clicks", "events"):
        spark.createDataFrame(rows, "props string").write.parquet(f"{tmp_path}/{name}.parquet")
    out = payloads.json_census(spark, str(tmp_path))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [props") == 2 and "monotonically_increasing_id" not in plan
    got = {(r.path, r.type): (r.n, r.rows, r.least_text) for r in out.filter("source = 'clicks'").collect()}
    assert got == {
        ("$", "object"): (5, 5, None),
        ("$.a", "array"): (5, 5, None),
        ("$.a[]", "number"): (7, 4, None),
        ("$.a[]", "object"): (5, 4, None),
        ("$.a[].b", "string"): (4, 4, "q"),
        ("$.a[].b", "null"): (1, 1, None),
        ("$.c", "string"): (3, 3, "x"),
    }

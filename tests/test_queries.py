"""Every query of the registry against its SQL in DuckDB, and the pure functions on small cases."""

import duckdb
import pytest

from tessera.operators import state
from tessera.operators.graph import cyclic_nodes
from tessera.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def plain(row):
    return tuple(round(x, 6) if isinstance(x, float) else x for x in row)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, con, name):
    df = registry.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted((plain(r) for r in df.select(*cols).collect()), key=str)
    res = con.execute(registry.ORACLES[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    want = sorted((plain([r[names.index(c)] for c in cols]) for r in res.fetchall()), key=str)
    assert got == want


def test_upsert_guard(spark):
    old = spark.createDataFrame([(1, "kept"), (2, "x")], "k int, v string")
    new = spark.createDataFrame([(1, ""), (2, "y"), (3, "z")], "k int, v string")
    out = {r.k: (r.v, r.action) for r in state.upsert(old, new, "k", {"v": lambda a, b: b != ""}).collect()}
    assert out == {1: ("kept", "unchanged"), 2: ("y", "updated"), 3: ("z", "created")}


def test_cycles(spark):
    from tessera.plans.lifecycle import with_checkpoints

    with_checkpoints(spark)
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (6, 6), (7, 1)], "src int, dst int")
    assert sorted(r.node for r in cyclic_nodes(e).collect()) == [1, 2, 3, 6]

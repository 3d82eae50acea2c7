"""Operator 11 against a brute-force version, and its files as they lie on disk."""

import datetime
import glob
import hashlib
import math
import os
import urllib.parse
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tessera.llm import schema_rewrite
from tessera.llm.drift import COLUMNS, drifted_clients

TYPES = "client_id long, master_id long, source string, updated_at timestamp_ntz, name string, email string, city string, nation_id int, segment string, balance double"
EPOCH = datetime.datetime(1970, 1, 1)


def local(uri):
    return urllib.parse.urlparse(uri).path


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, zlib.crc32(str(r[0]).encode()) if r[0] is not None else 0, r[0] or 0))
    per, out = 1 + len(rows) // 1000, []
    for f in range(-(-len(rows) // per)):
        v = zlib.crc32(f"7:{f}".encode()) % 24
        v = 0 if v > 15 else v
        own = []
        for r in rows[f * per : (f + 1) * per]:
            r = dict(zip(COLUMNS, r, strict=True))
            if v & 4:
                r |= {"nation_id": -1, "city": "none"}
            if v & 8 and r["balance"] is not None:
                r["balance"] = float(np.float32(r["balance"]))
            own.append(r)
        show = lambda c, x: "?" if x is None else str((x - EPOCH) // datetime.timedelta(microseconds=1)) if c == "updated_at" else str(math.floor(1048576 * x)) if c == "balance" else str(x)
        lines = ["|".join(show(c, r[c]) for c in COLUMNS) for r in own]
        names = [{"name": "email", "email": "name"}.get(c, c) if v & 1 else c for c in COLUMNS if not (v & 4 and c in ("nation_id", "city"))]
        names = names[:1] + names[:0:-1] if v & 2 else names
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        out.append((f, v, len(own), sum(x is None for r in own for x in r.values()), sha(",".join(show("client_id", r["client_id"]) for r in own)), sha("\n".join(lines)), ",".join(names), ",".join(COLUMNS), v != 0))
    return out


def clients(n, seed=1):
    rng = np.random.default_rng(seed)
    some = lambda x: None if rng.random() < 0.2 else x
    rows = [(i * 7919 % 100003, some(i), some("crm|x"), some(EPOCH + datetime.timedelta(days=19000, microseconds=i * 77777777)), some(f"nämé {i}"), some(f"a{i}@b"), some("Łódź"), some(int(i % 25)), some("\n"), some(float(rng.normal() * 1e4))) for i in range(n)]
    return [*rows[:-1], (None, *rows[-1][1:])] if n > 3 else rows


@pytest.mark.parametrize("n", [0, 1, 40, 1003])
def test_against_brute_force(spark, n):
    rows = clients(n)
    df = spark.createDataFrame(rows, TYPES).selectExpr("'x' AS path", "*", "1 AS file_no", "2 AS version")
    got = sorted(drifted_clients(spark, df).collect())
    assert [tuple(r)[:9] for r in got] == brute(rows)
    if not got:
        return
    folder = os.path.dirname(local(got[0].path))
    data = [p for p in glob.glob(f"{folder}/**", recursive=True, include_hidden=True) if p.endswith(".parquet")]
    assert sorted(data) == sorted(local(r.path) for r in got) and not glob.glob(f"{folder}/{schema_rewrite.STAGE}*")
    for r in got:
        schema = pq.read_schema(local(r.path))
        assert [(f.name, int(f.metadata[b"PARQUET:field_id"]), f.nullable) for f in schema] == [(c, i + 1, True) for i, c in enumerate(COLUMNS)]
        assert schema.field("nation_id").type == pa.int64() and schema.field("balance").type == pa.float64()
        assert pq.read_metadata(local(r.path)).num_rows == r.n_rows
    assert spark.read.parquet(folder).count() == n


def test_equal_rows_keep_their_number(spark):
    row = clients(5)[0]
    got = drifted_clients(spark, spark.createDataFrame([row] * 40 + clients(20, 2), TYPES)).collect()
    assert len(got) == 60 and {r.n_rows for r in got} == {1} and len({r.rows_sha256 for r in got if not r.version}) < sum(not r.version for r in got)


def field(name, kind, number):
    return pa.field(name, kind, metadata={"PARQUET:field_id": str(number)})


@pytest.fixture
def folder(tmp_path):
    """Six files: evolved already, renamed, with a column more, with one less, without rows, narrower types."""
    d = tmp_path / "files"
    d.mkdir()
    put = lambda name, fields, *cols: pq.write_table(pa.table(list(map(pa.array, cols)), schema=pa.schema(fields)) if cols[0] else pa.schema(fields).empty_table(), d / f"{name}.parquet", row_group_size=2)
    a, b = field("a", pa.int64(), 1), field("b", pa.string(), 2)
    put("same", [a, b], [1, 2, 3], ["x", None, "z"])
    put("named", [field("b", pa.int64(), 1), field("a", pa.string(), 2)], [4, 5, 6, 7, 8], ["p", "q", None, "s", "t"])
    put("more", [field("c", pa.float64(), 9), b, a], [0.5], ["m"], [9])
    put("less", [a], [10, None])
    put("none", [field("a", pa.int32(), 1)], [])
    put("narrow", [field("a", pa.int32(), 1), b], [11], ["n"])
    return str(d)


def evolved(spark):
    return schema_rewrite.with_ids(spark.createDataFrame([], "a long, b string").schema)


WANT = {"same": [(1, "x"), (2, None), (3, "z")], "named": [(4, "p"), (5, "q"), (6, None), (7, "s"), (8, "t")], "more": [(9, "m")], "less": [(10, "none"), (None, "none")], "none": [], "narrow": [(11, "n")]}


def contents(folder):
    out = {}
    for p in glob.glob(f"{folder}/*.parquet"):
        t = pq.read_table(p)
        assert t.schema.names == ["a", "b"] and t.schema.field("a").type == pa.int64()
        out[os.path.basename(p).removesuffix(".parquet")] = [tuple(r.values()) for r in t.to_pylist()]
    return out


def test_rewrite_of_a_folder(spark, folder):
    before = os.stat(f"{folder}/same.parquet")
    done = schema_rewrite.rewrite(spark, folder, evolved(spark), {"b": "none"})
    assert sorted(os.path.basename(p) for p in done) == ["less.parquet", "more.parquet", "named.parquet", "narrow.parquet", "none.parquet"]
    assert contents(folder) == WANT
    after = os.stat(f"{folder}/same.parquet")
    assert (before.st_ino, before.st_mtime_ns) == (after.st_ino, after.st_mtime_ns)
    assert schema_rewrite.rewrite(spark, folder, evolved(spark), {"b": "none"}) == []
    assert spark.read.schema(evolved(spark)).parquet(folder).count() == 12


def test_interrupted_rewrite_is_finished_or_thrown_away(spark, folder, monkeypatch):
    finish = schema_rewrite._finish
    monkeypatch.setattr(schema_rewrite, "_finish", lambda *a: None)
    schema_rewrite.rewrite(spark, folder, evolved(spark), {"b": "none"})
    monkeypatch.setattr(schema_rewrite, "_finish", finish)
    (stage,) = glob.glob(f"{folder}/{schema_rewrite.STAGE}*")
    moves = {os.path.basename(r.path): r for r in spark.read.parquet(f"{stage}/moves").collect()}
    os.replace(local(moves["more.parquet"].staged), local(moves["more.parquet"].path))  # one move was done
    os.makedirs(f"{folder}/{schema_rewrite.STAGE}half/full")
    schema_rewrite.resume(spark, folder)
    assert not glob.glob(f"{folder}/{schema_rewrite.STAGE}*") and contents(folder) == WANT


def test_columns_without_ids(spark, tmp_path):
    pq.write_table(pa.table({"a": [1]}), tmp_path / "x.parquet")
    with pytest.raises(ValueError, match="without a field id"):
        schema_rewrite.rewrite(spark, str(tmp_path), evolved(spark), {})
    assert os.listdir(tmp_path) == ["x.parquet"]

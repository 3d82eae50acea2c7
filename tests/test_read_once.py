"""Queries of imports cut the documents once, however many tables and runs come from them."""

import pytest
from pyspark.sql import functions as F

from tessera.plans import imports, registry

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["import_runs", "import_releases", "batch_acceptance"])
def test_documents_are_cut_once(spark, monkeypatch, name):
    from tessera.plans import acceptance

    seen = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def counted(doc_id):
        seen.add(1)
        return True

    cut = imports.cards
    for module in (imports, acceptance):
        monkeypatch.setattr(module, "cards", lambda *a: cut(*a).filter(counted("doc_id")), raising=False)
    registry.QUERIES[name](spark, DIR).collect()
    assert seen.value == spark.read.parquet(f"{DIR}/documents.parquet").count()


def test_import_releases_against_sql(spark):
    """What each entry of the log shows, from the documents' ids and first lines alone."""
    import duckdb

    d = f"(SELECT doc_id % 5 <> 0 AS a, doc_id % 3 <> 0 AS b, doc_id % 4 <> 0 AS c FROM '{DIR}/documents.parquet' WHERE length(split_part(text, chr(10), 1)) >= {imports.LEAST})"
    first = f"SELECT {{}} AS version, 'run-1' AS release_id, 'draft' AS status, count(*) AS n FROM {d} WHERE a"
    later = f"SELECT {{0}}, '{{1}}', CASE WHEN {{2}} THEN 'published' ELSE 'draft' END, count(*) FROM {d} WHERE a OR {{2}} GROUP BY ALL"
    want = duckdb.sql(" UNION ALL ".join([first.format(1), later.format(2, "run-2", "b"), first.format(3), later.format(4, "run-3", "c")])).fetchall()
    assert sorted(tuple(r) for r in registry.QUERIES["import_releases"](spark, DIR).select("version", "release_id", "status", "n").collect()) == sorted(want)

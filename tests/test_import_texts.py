"""A run writes the texts of its cards once, as locales, and not again to settle which cards are gated; a release whose table can't be written isn't published."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import imports
from tessera.operators.releases import ReleaseStore
from tests.test_imports import actions, cards, got


def test_no_texts_are_settled(spark):
    seen = []

    def settled(df):
        seen.append(set(df.columns))
        return spark.createDataFrame(df.collect(), df.schema)

    one = imports.drafts(imports.empty(spark), cards(spark, ("1", "a", "h1", []), ("2", "b", "h1", []), ("3", "a", "h9", []), ("0", "a", "h8", ["short"])), settled)
    assert got(one) == {"a": ("draft", 1), "b": ("draft", 1)} and seen
    assert actions(one) == {"0": ("invalid", ["short"]), "1": ("created", []), "2": ("created", []), "3": ("invalid", ["duplicate_key"])}
    assert {r.prompt for r in one.tables["locales"].collect()} == {"prompt of a", "prompt of b"}
    assert not any(columns & {"en", "ru", "prompt"} for columns in seen)


def test_nothing_is_published_where_a_table_fails(spark, tmp_path):
    store = ReleaseStore(spark, str(tmp_path), "main")
    good = spark.range(3)
    with pytest.raises(Exception, match="on purpose"):
        store.publish("r", {"good": good, "bad": good.select(F.raise_error(F.lit("on purpose")).alias("x")), "more": good}, "x", "t1")
    assert store.head() is None
    store.publish("r", {"good": good, "more": good}, "x", "t1")
    assert store.read("more").count() == 3


def test_tables_written_together(spark, tmp_path):
    from tessera.sources.scratch import Scratch

    scratch = Scratch(spark, "together")
    first = scratch.write(spark.range(2))
    both = scratch.write_all({"a": spark.range(3), "b": spark.range(4).select(F.col("id").alias("x"))})
    last = scratch.write(spark.range(5))
    assert [df.count() for df in (first, both["a"], both["b"], last)] == [2, 3, 4, 5] and both["b"].columns == ["x"]

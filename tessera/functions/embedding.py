"""Embedders: a provider turns an array column of texts into vectors. The built-in ones need no service and no Python worker."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import tokens

DIMENSIONS = 1024
#: A provider: a text column to a vector column.
Provider = Callable[[Column], Column]


def hashed(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """Each word adds to one place, told by the first four bytes of its SHA-256, 1 to 1 6/7 by the fifth, with the sign of the sixth's lowest bit; of length 1, or zeros."""

    def part(h: Column, at: int, n: int) -> Column:
        return F.conv(F.substring(h, at, n), 16, 10).cast("long")

    def entry(word: Column) -> Column:
        h = F.sha2(word, 256)
        size = 1.0 + (part(h, 9, 2) % 7) / F.lit(7.0)
        return F.struct((part(h, 1, 8) % dimensions).cast("int").alias("at"), F.when(part(h, 11, 2) % 2 == 1, -size).otherwise(size).alias("x"))

    zeros = F.array_repeat(F.lit(0.0), dimensions)
    added = F.aggregate(F.transform(tokens(text), entry), zeros, lambda v, e: F.transform(v, lambda x, i: F.when(i == e["at"], x + e["x"]).otherwise(x)))
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(F.transform(F.array(added), lambda v: F.struct(v.alias("v"), norm(v).alias("n"))), lambda p: F.transform(p["v"], lambda x: F.when(p["n"] > 0, x / p["n"]).otherwise(0.0).cast("float")))[0]


def sparse(texts: DataFrame, key: str, text: str, dimensions: int = DIMENSIONS, raw: bool = False) -> DataFrame:
    """key, at, x: the entries of ``hashed`` that are not zero, one word a row and summed; for long texts. raw: before they are made of length 1."""
    h = texts.select(key, tokens(F.col(text)).alias("w")).select(key, F.explode("w").alias("w")).withColumn("h", F.sha2("w", 256))
    part = lambda at, n: F.conv(F.substring("h", at, n), 16, 10).cast("long")
    size = 1.0 + (part(9, 2) % 7) / F.lit(7.0)
    e = h.select(key, (part(1, 8) % dimensions).cast("int").alias("at"), F.when(part(11, 2) % 2 == 1, -size).otherwise(size).alias("x")).groupBy(key, "at").agg(F.sum("x").alias("x")).filter("abs(x) > 1e-12")
    if raw:
        return e
    norm = e.groupBy(key).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return e.join(norm, key).select(key, "at", (F.col("x") / F.col("norm")).alias("x"))


def one_hot(text: Column, groups: int) -> Column:
    """A vector with a one at the first number in the text, for tests."""
    at = F.coalesce(F.regexp_extract(text, r"(\d+)", 1).try_cast("int"), F.lit(0)) % groups
    return F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda i: (i == at).cast("float"))


def literal(vector: Column) -> Column:
    """[x,y,...] with eight decimals."""
    return F.concat(F.lit("["), F.array_join(F.transform(vector, lambda x: F.format_string("%.8f", x.cast("double"))), ","), F.lit("]"))


def checked(vector: Column, dimensions: int = DIMENSIONS) -> Column:
    """The vector, or an error if a provider gave one of another size."""
    return F.when(F.size(vector) == dimensions, vector).otherwise(F.raise_error(F.concat(F.lit("dimensions: "), F.size(vector).cast("string"))))


def backfill(missing: DataFrame, have: DataFrame, provider: Provider, profile: str, active: set[str]) -> DataFrame:
    """have (locale_key, profile, content_hash, vector) with vectors for those of missing (locale_key, content_hash, text) that the profile lacks. A profile that is not active gets none."""
    if profile not in active:
        return have
    new = missing.join(have.filter(F.col("profile") == profile), ["locale_key", "content_hash"], "left_anti")
    return have.unionByName(new.select("locale_key", F.lit(profile).alias("profile"), "content_hash", provider(F.col("text")).alias("vector")))

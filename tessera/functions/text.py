"""Text, trigram, vector and hashing expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import unaccent


def slugify(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def comparable(c: Column) -> Column:
    """White space collapsed, lower case."""
    return F.lower(F.trim(F.regexp_replace(c, r"[ \t\n\r]+", " ")))


def first_non_blank(*cols: Column) -> Column:
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in cols])


def tokens(c: Column) -> Column:
    """Words of letters and digits of any script, lower case."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def terms(c: Column) -> Column:
    """Search terms: words without accents."""
    return tokens(unaccent(c))


def trigrams(c: Column) -> Column:
    """Distinct trigrams of all words, each padded by two blanks before and one after."""
    words = F.transform(tokens(c), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substr(w, i, F.lit(3)))))
    return F.array_distinct(grams)


def jaccard(a: Column, b: Column) -> Column:
    common = F.size(F.array_intersect(a, b))
    return common / F.nullif(F.size(a) + F.size(b) - common, F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised_vector(v: Column) -> Column:
    """Of length 1, in doubles; null for a zero vector."""
    x = F.transform(v, lambda e: e.cast("double"))
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(x, lambda e: e / norm))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def fingerprint(prefix: str, seed: Column) -> Column:
    return F.concat(F.lit(prefix), F.substr(F.sha2(seed, 256), F.lit(1), F.lit(16)))


def backoff_seconds(attempts: Column) -> Column:
    """Quadratic, five minutes at most."""
    return F.least(attempts * attempts, F.lit(300))

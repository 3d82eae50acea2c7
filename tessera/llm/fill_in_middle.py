"""Operator 13, fill-in-middle: lookaround splitting.

A unit grammar is translated to a zero-width boundary: a place between two characters of which the class of the one
before and the class of the one behind tell that one unit ends and the next begins. Spark's ``split`` at that boundary gives the units
with nothing lost, so that prefix, middle and suffix are slices of one array. Empty text has no unit and is handled apart.

Scale: column expressions alone, one row in and one row out; no shuffle, no Python, and no more memory than a text and its units.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import need


@dataclass(frozen=True)
class Units:
    """pattern: the grammar, whose matches from left to right are the units. boundary: the zero-width place between two of them."""

    pattern: str
    boundary: str


def ended(by: str) -> Units:
    """Units that end with a character of the class ``by``; the last may lack it."""
    return Units(f"[^{by}]*[{by}]|[^{by}]+", rf"(?<=[{by}])(?=[\s\S])")


def tailed(tail: str) -> Units:
    """Units that end with all characters of the class ``tail`` that follow; a text may begin with a unit of nothing else."""
    return Units(f"[^{tail}]*[{tail}]+|[^{tail}]+", f"(?<=[{tail}])(?=[^{tail}])")


def runs(*classes: str) -> Units:
    """Runs of each of the disjoint classes, and runs of what is in none of them."""
    rest = "".join(classes)
    return Units("|".join(f"[{c}]+" for c in classes) + f"|[^{rest}]+", "|".join(f"(?<=[{c}])(?=[^{c}])|(?<=[^{c}])(?=[{c}])" for c in classes))


SPACE = r"\x20\x09-\x0D"
GRAMMARS = {"lines": ended(r"\n"), "words": tailed(SPACE), "runs": runs("A-Za-z0-9_", SPACE)}
MARKERS = ("<P>", "<S>", "<M>")


def units(text: Column, grammar: Units) -> Column:
    """The units of a text, in order; none of an empty one."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, grammar.boundary, -1))


def apart(markers: tuple[str, str, str]) -> None:
    """No marker may begin where another has not ended yet, so that the first place of each in an output is its own."""
    for a in markers:
        for b in markers:
            if not a or (a != b and a in b) or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)))):
                raise ValueError(f"markers {a!r} and {b!r} may overlap")
    if len(set(markers)) != 3:
        raise ValueError("three different markers are needed")


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text, from output and form alone."""
    part = F.split(output, "|".join(map(_literal, markers)), -1)
    first, second, middle = (F.get(part, F.lit(i)) for i in (1, 2, 3))
    return F.when(form == "plain", output).when(form == "psm", F.concat(first, middle, second)).otherwise(F.concat(second, middle, first))


def _literal(marker: str) -> str:
    return re.sub(r"([^A-Za-z0-9])", r"\\\1", marker)


def fill_in_middle(docs: DataFrame, grammar: Units = GRAMMARS["lines"], rate: int = 100, spm: int = 50, seed: int = 7, markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """doc_id, text, n, form, prefix, middle, suffix, output: one row for each input row.

    The cuts and the form follow from sha256 of seed and doc_id alone, so that a run repeated on any number of executors gives the same. ``rate`` per cent
    of the texts are transformed, ``spm`` per cent of these with the suffix first. A null text is an empty one; empty texts, and those that hold a marker, stay plain, with null
    prefix, middle and suffix. A null doc_id is hashed as no digits. Rows that share a doc_id draw the same numbers, each on its own units; repeated rows give repeated rows.
    Other columns play no part. An empty table gives no row.
    """
    apart(markers)
    docs = need(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    docs = docs.withColumn("digits", digits).withColumn("units", units(F.col("text"), grammar)).withColumn("n", F.size("units").cast("long"))
    h1, h2, h3, h4 = (F.conv(F.substring("digits", 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4))
    plain = (F.col("text") == "") | (h3 % 100 >= rate)
    for m in markers:
        plain = plain | F.contains("text", F.lit(m))
    docs = docs.withColumn("form", F.when(plain, "plain").when(h4 % 100 < spm, "spm").otherwise("psm"))
    a, b = h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)
    docs = docs.withColumn("a", F.least(a, b).cast("int")).withColumn("b", F.greatest(a, b).cast("int"))
    piece = lambda begin, end: F.when(F.col("form") != "plain", F.array_join(F.slice("units", begin + 1, end - begin), ""))
    docs = docs.select("doc_id", "text", "n", "form", piece(F.lit(0), F.col("a")).alias("prefix"), piece(F.col("a"), F.col("b")).alias("middle"), piece(F.col("b"), F.col("n").cast("int")).alias("suffix"))
    p, s, m = map(F.lit, markers)
    psm, spm_ = F.concat(p, "prefix", s, "suffix", m, "middle"), F.concat(s, "suffix", p, "prefix", m, "middle")
    return docs.withColumn("output", F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", psm).otherwise(spm_))


def fill_in_middle_report(docs: DataFrame, grammar: Units = GRAMMARS["lines"]) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256: of each row, with what is rebuilt from the output."""
    out = fill_in_middle(docs, grammar)
    chars = lambda c: F.length(c).cast("long")
    return out.select("doc_id", "n", "form", chars("prefix").alias("prefix_chars"), chars("middle").alias("middle_chars"), F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))

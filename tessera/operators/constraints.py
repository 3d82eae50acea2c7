"""Declared constraints, compiled to one table of violations.

A table's rules name what it refers to, what must hold for a row together with what it refers to, and what must be unique. They are compiled to one
plan a table: each reference is one left join that brings the columns the guards speak of, all guards are one projection over it, and uniqueness is a count with map-side sums
of which only the keys that break it are joined back. Nothing is collected, and a violation is a row of the result, not an error.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: violations(): which row of which table breaks which guard, and how.
VIOLATIONS = "table string, row_id string, guard string, code string"


@dataclass(frozen=True)
class Reference:
    """columns of the row that name a row of another table by its ``keys``; ``brings``: new name to column of that table. Where nothing is found, or a column is null, what it brings is null."""

    columns: tuple[str, ...]
    table: str
    keys: tuple[str, ...]
    brings: dict[str, str]


@dataclass(frozen=True)
class Rules:
    """guards: name to (code, condition in SQL that a sound row doesn't fulfil), the first of which that holds is told. unique: name to (columns, condition of the rows that count)."""

    table: str
    key: str
    references: tuple[Reference, ...] = ()
    guards: dict[str, list[tuple[str, str]]] = field(default_factory=dict)
    unique: dict[str, tuple[tuple[str, ...], str]] = field(default_factory=dict)


def one_of(column: str, values: tuple[str, ...]) -> str:
    return f"{column} IS NULL OR {column} NOT IN ({', '.join(repr(v) for v in values)})"


def beyond(column: str, least: float, most: float) -> str:
    """Null is allowed."""
    return f"{column} < {least} OR {column} > {most}"


def unlike(column: str, pattern: str) -> str:
    return f"{column} IS NULL OR NOT regexp_like({column}, '{pattern}')"


def empty(column: str) -> str:
    return f"coalesce(length(trim({column})), 0) = 0"


def brought(rows: DataFrame, reference: Reference, tables: dict[str, DataFrame]) -> DataFrame:
    """rows with what the reference brings. A key that comes again in the other table must bring the same each time; else the largest counts, so that rows never multiply."""
    names = [f"__key{i}" for i in range(len(reference.keys))]
    other = tables[reference.table].select(*[F.col(k).alias(n) for k, n in zip(reference.keys, names, strict=True)], F.struct(*[F.col(c).alias(n) for n, c in reference.brings.items()]).alias("__brings"))
    other = other.groupBy(*names).agg(F.max("__brings").alias("__brings"))
    on = reduce(lambda a, b: a & b, [F.col(c) == F.col(n) for c, n in zip(reference.columns, names, strict=True)])
    return rows.join(other, on, "left").select(*rows.columns, "__brings.*")


def first_broken(guard: str, conditions: list[tuple[str, str]]) -> Column:
    code = F.coalesce(*[F.when(F.expr(condition), F.lit(code)) for code, condition in conditions])
    return F.when(code.isNotNull(), F.struct(F.lit(guard).alias("guard"), code.alias("code")))


def of_table(rules: Rules, tables: dict[str, DataFrame]) -> DataFrame:
    rows = tables[rules.table]
    for reference in rules.references:
        rows = brought(rows, reference, tables)
    broken = [first_broken(g, c) for g, c in rules.guards.items()]
    for i, (name, (columns, where)) in enumerate(rules.unique.items()):
        twice = tables[rules.table].filter(where).groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        names = [f"__u{i}_{c}" for c in columns]
        twice = twice.select(*[F.col(c).alias(n) for c, n in zip(columns, names, strict=True)], F.lit(True).alias(f"__twice{i}"))
        on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(columns, names, strict=True)])
        rows = rows.join(twice, on & F.expr(where), "left").drop(*names)
        broken.append(F.when(F.col(f"__twice{i}"), F.struct(F.lit(name).alias("guard"), F.lit("not_unique").alias("code"))))
    rows = rows.select(F.col(rules.key).cast("string").alias("row_id"), F.explode(F.array_compact(F.array(*broken))).alias("x"))
    return rows.select(F.lit(rules.table).alias("table"), "row_id", "x.guard", "x.code")


def violations(rules: list[Rules], tables: dict[str, DataFrame]) -> DataFrame:
    """table, row_id, guard, code: every guard that a row breaks, once a row."""
    return reduce(DataFrame.unionByName, [of_table(r, tables) for r in rules])

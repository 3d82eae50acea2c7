"""JSON of any depth and shape as columns: a walk over VARIANT values, without a schema and without leaving the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values nested deeper are an error.
DEPTH = 100
#: What schema_of_variant tells of scalars, and JSON's own names.
SCALARS = {"STRING": "string", "BOOLEAN": "boolean", "VOID": "null"}


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is made once, however often ``then`` names it: a lambda makes what it names again each time."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def type_name(v: Column) -> Column:
    """object, array, string, number, boolean or null."""
    kind = F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)
    return F.when(kind == "OBJECT", "object").when(kind == "ARRAY", "array").otherwise(F.coalesce(*[F.when(kind == k, n) for k, n in SCALARS.items()], F.lit("number")))


def _node(path: Column, v: Column) -> Column:
    return F.struct(path.alias("path"), v.alias("v"))


def _opened(node: Column) -> Column:
    """A value with its fields, if it is an object, its entries, if it is an array, and its type."""
    fields, entries = F.map_entries(F.try_variant_get(node["v"], "$", "map<string,variant>")), F.try_variant_get(node["v"], "$", "array<variant>")
    both = let(F.struct(fields.alias("fields"), entries.alias("entries")), lambda x: F.struct(
        x["fields"].alias("fields"), x["entries"].alias("entries"),
        F.when(x["fields"].isNotNull(), "object").when(x["entries"].isNotNull(), "array").otherwise(type_name(node["v"])).alias("type"),
    ))
    return F.struct(node["path"].alias("path"), node["v"].alias("v"), both.alias("x"))


def _children(opened: Column) -> Column:
    """The values within a value, with their paths; none of a scalar."""
    path, x = opened["path"], opened["x"]
    named = F.transform(x["fields"], lambda e: _node(F.concat(path, F.lit("."), e["key"]), e["value"]))
    numbered = F.transform(x["entries"], lambda e: _node(F.concat(path, F.lit("[]")), e))
    return F.coalesce(named, numbered, F.array().cast("array<struct<path:string,v:variant>>"))


def walk(payload: Column, depth: int = DEPTH) -> Column:
    """All values of a JSON text, containers too: array<struct<path, type, text>>, outer values first. text: a string's characters, a number or boolean as written in JSON; null for containers and JSON's null.

    Names follow a dot, entries of an array are ``[]``. Null for a text that is no JSON, or names a field of an object twice.
    """
    told = lambda o: F.struct(o["path"].alias("path"), o["x"]["type"].alias("type"), F.when(~o["x"]["type"].isin("object", "array"), F.try_variant_get(o["v"], "$", "string")).alias("text"))
    start = lambda v: F.struct(F.array(_node(F.lit("$"), v)).alias("front"), F.array().cast("array<struct<path:string,type:string,text:string>>").alias("out"))
    levels = F.least(F.lit(depth), F.regexp_count(payload, F.lit("[\\[{]")) + 1)  # brackets bound the depth
    step = lambda acc, _: let(F.transform(acc["front"], _opened), lambda o: F.struct(F.flatten(F.transform(o, _children)).alias("front"), F.concat(acc["out"], F.transform(o, told)).alias("out")))
    end = lambda acc: F.when(F.size(acc["front"]) > 0, F.raise_error(F.lit(f"JSON nested deeper than {depth}"))).otherwise(acc["out"])
    return let(F.try_parse_json(payload), lambda v: F.when(v.isNotNull(), F.aggregate(F.sequence(F.lit(1), levels), start(v), step, end)))


def strings(payload: Column) -> Column:
    """All string values, at any depth; none of a text that is no JSON."""
    return F.transform(F.filter(F.coalesce(walk(payload), F.array().cast("array<struct<path:string,type:string,text:string>>")), lambda x: x["type"] == "string"), lambda x: x["text"])


def canonical(payload: Column) -> Column:
    """The JSON text with sorted names and without white space, unknown fields and all; null for a text that is no JSON."""
    return F.to_json(F.try_parse_json(payload))

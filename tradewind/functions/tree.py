"""Nested documents as VARIANT values: a walk over all their objects, and fields of whatever kind."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: No JSON parser here takes deeper documents.
DEEPEST = 1000


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def children(node: Column) -> Column:
    """The values of an object or array; none of anything else."""
    of_array, of_object = F.try_variant_get(node, "$", "array<variant>"), F.map_values(F.try_variant_get(node, "$", "map<string,variant>"))
    return F.coalesce(of_array, of_object, F.array().cast("array<variant>"))


def nodes(raw: Column) -> Column:
    """array<variant>: all values in the JSON text `raw`, at any depth, level by level; null if it is no JSON.

    Runs within the row, without a shuffle or a Python worker. As many levels are looked at as the
    text has opening brackets, and none after the last that has values.
    """
    levels = F.least(F.lit(DEEPEST), F.regexp_count(raw, F.lit(r"[\[{]")))

    def deeper(acc: Column, _: Column) -> Column:
        below = F.flatten(F.transform(acc["level"], children))
        return F.when(F.size(acc["level"]) == 0, acc).otherwise(let(below, lambda b: F.struct(F.concat(acc["found"], b).alias("found"), b.alias("level"))))

    def walk(top: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), levels + 1), F.struct(F.array(top).alias("found"), F.array(top).alias("level")), deeper, lambda acc: acc["found"])

    return let(F.try_parse_json(raw), lambda v: F.when(v.isNotNull(), walk(v)))


def listed(node: Column, key: str) -> Column:
    """The field `key` as array<variant>: an array's elements, or the one value; empty if it is absent or null."""
    one = F.try_variant_get(node, f'$["{key}"]', "variant")
    return let(one, lambda x: F.when(x.isNull() | F.is_variant_null(x), F.array().cast("array<variant>")).otherwise(F.coalesce(F.try_variant_get(x, "$", "array<variant>"), F.array(x))))


def text(node: Column, key: str, of_object: str = "name") -> Column:
    """The field `key` as a string: of an array its first element, of an object its field `of_object`; null if it is absent."""
    first = F.get(listed(node, key), F.lit(0))
    return let(first, lambda x: F.when(F.try_variant_get(x, "$", "map<string,variant>").isNotNull(), F.try_variant_get(x, f'$["{of_object}"]', "string")).otherwise(F.try_variant_get(x, "$", "string")))


def figure(node: Column, key: str) -> Column:
    """The field `key` as a double if it is a number or a text that is one with a decimal point; else null."""
    return let(F.trim(text(node, key)), lambda t: F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), t.try_cast("double")))


def is_object(node: Column) -> Column:
    return F.try_variant_get(node, "$", "map<string,variant>").isNotNull()


def has_type(node: Column, kind: str) -> Column:
    """Whether an object's @type is `kind`, or one of a list that is, in letters of either case."""
    return is_object(node) & F.exists(listed(node, "@type"), lambda k: F.lower(F.coalesce(F.try_variant_get(k, "$", "string"), F.lit(""))) == kind)

"""Nested JSON values without Python rows: deep merge, and the leaves of nested arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Levels that are merged key by key, or flattened.
DEPTH = 8


def _is(value: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith(kind), F.lit(False))


def _merged(base: Column, new: Column, depth: int) -> Column:
    as_map = lambda v: v.cast("map<string,variant>")

    def either(_: Column, old: Column, other: Column) -> Column:
        inner = _merged(old, other, depth - 1) if depth > 1 else other
        return F.when(other.isNull(), old).when(_is(old, "OBJECT") & _is(other, "OBJECT"), inner).otherwise(other)

    return F.to_variant_object(F.map_zip_with(as_map(base), as_map(new), either))


def merged_json(base: Column, new: Column, depth: int = DEPTH) -> Column:
    """A variant: both texts' objects merged key by key; the new one wins, a JSON null of its own too.

    Objects inside objects are merged alike, depth levels deep; from there on, and where one side is no object, the
    new value stands as a whole.  Where either text is null or no JSON, the other one is the result.
    """
    a, b = F.try_parse_json(base), F.try_parse_json(new)
    return F.when(a.isNull(), b).when(b.isNull(), a).when(_is(a, "OBJECT") & _is(b, "OBJECT"), _merged(a, b, depth)).otherwise(b)


def leaves(value: Column, depth: int = DEPTH) -> Column:
    """array<variant>: the values of nested arrays one after the other, depth levels deep; objects and scalars count whole, null for null."""

    def inside(v: Column, left: int) -> Column:
        if not left:
            return F.array(v)
        return F.when(_is(v, "ARRAY"), F.flatten(F.transform(v.cast("array<variant>"), lambda x: inside(x, left - 1)))).otherwise(F.array(v))

    return F.when(value.isNotNull(), inside(value, depth))


def all_of_type(value: Column, kind: str, depth: int = DEPTH) -> Column:
    """Whether every leaf has a type by its name among variants (STRING, BIGINT, BOOLEAN, OBJECT ...); true without leaves."""
    return F.forall(leaves(value, depth), lambda x: _is(x, kind))

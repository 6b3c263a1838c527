"""Objects: maps, and structs whose fields share a type."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from ..errors import AnalysisError
from .registry import Arg, Registry


def as_map(a: Arg) -> Column:
    if a.is_map:
        return a.col
    if a.is_struct:
        pairs = [x for f in a.type.fields for x in (F.lit(f.name), a.col[f.name])]
        return F.when(a.col.isNotNull(), F.create_map(*pairs))
    raise AnalysisError(f"not an object: {a.type.simpleString()}")


def keys(a: Arg) -> Column:
    if a.is_struct:
        return F.when(a.col.isNotNull(), F.array(*(F.lit(f.name) for f in a.type.fields)))
    return F.map_keys(as_map(a))


def element_at(a: Arg, key: Arg) -> Column:
    """1-based element or the value of a key; null where there is none."""
    if a.is_array:
        at = key.col.cast("int")
        return F.when(at >= 1, F.get(a.col, at - 1))
    return F.try_element_at(as_map(a), key.col)


def from_entries(a: Arg) -> Column:
    """From pairs, structs or two-element arrays; the last of equal keys wins."""
    if isinstance(a.type, T.ArrayType) and isinstance(a.type.elementType, T.ArrayType):
        return F.map_from_entries(F.transform(a.col, lambda p: F.struct(F.get(p, F.lit(0)).alias("key"), F.get(p, F.lit(1)).alias("value"))))
    return F.map_from_entries(a.col)


def register(r: Registry) -> None:
    r.register("map_keys", keys, 1)
    r.register("map_values", lambda a: F.map_values(as_map(a)), 1)
    r.register("map_entries", lambda a: F.map_entries(as_map(a)), 1)
    r.register("element_at", element_at, 2)
    r.register("map_concat", lambda a, b: F.map_concat(as_map(a), as_map(b)), 2)
    r.register("map_from_entries", from_entries, 1)

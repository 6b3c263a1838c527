"""Arrays."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from ..errors import AnalysisError
from .registry import Arg, Registry


def join(a: Arg, by: Arg, null: Arg | None = None) -> Column:
    texts = F.transform(a.col, lambda x: x.cast("string"))
    if null is None:
        return F.array_join(texts, by.literal) if isinstance(by.literal, str) else F.call_function("array_join", texts, by.col)
    return F.call_function("array_join", texts, by.col, null.col)


def cardinality(a: Arg) -> Column:
    if isinstance(a.type, T.StructType):
        return F.when(a.col.isNotNull(), F.lit(len(a.type.fields)).cast("bigint"))
    return F.cardinality(a.col).cast("bigint")


def flatten(a: Arg) -> Column:
    """One level; an array without arrays inside stays."""
    if not a.is_array:
        raise AnalysisError("flatten takes an array")
    return F.flatten(a.col) if isinstance(a.type.elementType, T.ArrayType) else a.col


def part(a: Arg, start: Arg, length: Arg) -> Column:
    """From the 1-based start; a start under 1 or a length under 0 gives an empty array."""
    at, n = start.col.cast("int"), length.col.cast("int")
    return F.when((at < 1) | (n < 0), F.slice(a.col, F.lit(1), F.lit(0))).otherwise(F.slice(a.col, F.greatest(at, F.lit(1)), F.greatest(n, F.lit(0))))


def register(r: Registry) -> None:
    r.register("array_sort", lambda a: F.array_sort(a.col), 1)
    r.register("array_distinct", lambda a: F.array_distinct(a.col), 1)
    r.register("array_contains", lambda a, x: F.array_contains(a.col, x.col), 2)
    r.register("array_join", join, 2, 3)
    r.register("array_min", lambda a: F.array_min(a.col), 1)
    r.register("array_max", lambda a: F.array_max(a.col), 1)
    r.register("array_position", lambda a, x: F.array_position(a.col, x.col), 2)
    r.register("cardinality", cardinality, 1)
    r.register("flatten", flatten, 1)
    r.register("array_intersect", lambda a, b: F.array_intersect(a.col, b.col), 2)
    r.register("array_union", lambda a, b: F.array_union(a.col, b.col), 2)
    r.register("array_except", lambda a, b: F.array_except(a.col, b.col), 2)
    r.register("array_remove", lambda a, x: F.array_remove(a.col, x.col), 2)
    r.register("slice", part, 3)
    r.register("shuffle", lambda a: F.reverse(a.col), 1)  # the dialect's shuffle is a fixed one

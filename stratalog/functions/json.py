"""JSON texts, by way of VARIANT."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..errors import AnalysisError
from .registry import Arg, Registry


def at_path(s: Arg, path: Arg) -> Column:
    if not isinstance(path.literal, str):
        raise AnalysisError("a JSON path must be a literal")
    return F.try_variant_get(F.try_parse_json(s.col), path.literal, "variant")


def kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def scalar(v: Column) -> Column:
    return ~F.regexp_like(kind(v), F.lit("^(OBJECT|ARRAY)"))


def text(v: Column) -> Column:
    return F.to_json(v)


def extract_scalar(s: Arg, path: Arg) -> Column:
    v = at_path(s, path)
    return F.when(scalar(v) & ~F.is_variant_null(v), F.try_variant_get(v, "$", "string"))


def array_contains(s: Arg, x: Arg) -> Column:
    kinds = {bool: "boolean", int: "bigint", float: "double", str: "string"}
    wanted = kinds.get(type(x.literal)) or x.type.simpleString()
    schema = {"boolean": "BOOLEAN", "string": "STRING"}.get(wanted)
    items = F.try_variant_get(F.try_parse_json(s.col), "$", "array<variant>")

    def same(v: Column) -> Column:
        fits = kind(v) == schema if schema else F.regexp_like(kind(v), F.lit("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"))
        return fits & (F.try_variant_get(v, "$", wanted) == x.col)

    return F.when(s.col.isNotNull() & x.col.isNotNull(), F.coalesce(F.exists(items, lambda v: F.coalesce(same(v), F.lit(False))), F.lit(False)))


def size(s: Arg, path: Arg) -> Column:
    """Elements or keys at the path, 0 for a scalar, null where nothing is."""
    v = at_path(s, path)
    found = kind(v)
    items = F.size(F.try_variant_get(v, "$", "array<variant>"))
    keys = F.size(F.json_object_keys(text(v)))
    return F.when(F.startswith(found, F.lit("ARRAY")), items).when(F.startswith(found, F.lit("OBJECT")), keys).when(v.isNotNull(), F.lit(0)).cast("bigint")


def register(r: Registry) -> None:
    r.register("json_extract", lambda s, p: text(at_path(s, p)), 2)
    r.register("json_extract_scalar", extract_scalar, 2)
    r.register("json_array_length", lambda s: F.json_array_length(s.col).cast("bigint"), 1)
    r.register("json_array_contains", array_contains, 2)
    r.register("json_size", size, 2)
    r.register("json_format", lambda x: x.col.cast("string"), 1)
    r.register("json_parse", lambda s: F.when(F.try_parse_json(s.col).isNotNull(), s.col), 1)
    r.register("is_json_scalar", lambda s: scalar(F.try_parse_json(s.col)), 1)

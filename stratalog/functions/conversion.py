"""Types and bases."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from ..errors import AnalysisError
from .registry import Arg, Registry

NAMES = {T.StringType: "string", T.BooleanType: "boolean", T.TimestampType: "datetime", T.TimestampNTZType: "datetime", T.DateType: "datetime", T.ArrayType: "array", T.MapType: "object", T.NullType: "null"}
FRACTIONS = (T.DoubleType, T.FloatType, T.DecimalType)


def type_name(kind: T.DataType) -> str:
    if isinstance(kind, T.StructType):
        fields = kind.fieldNames()
        return "host" if fields == ["hostname", "port"] else "http_request" if fields[:2] == ["http_method", "url"] else "object"
    return next((name for k, name in NAMES.items() if isinstance(kind, k)), "float" if isinstance(kind, FRACTIONS) else "integer")


def typeof(a: Arg) -> Column:
    named = F.when(a.col.isNull(), F.lit("null")).otherwise(F.lit(type_name(a.type)))
    return named if a.missing is None else F.when(a.missing, F.lit("missing")).otherwise(named)


def try_cast(a: Arg, to: Arg) -> Column:
    """Null for a value that doesn't fit, and for a type that isn't known."""
    name = to.literal.lower() if isinstance(to.literal, str) else ""
    kind = type_name(a.type)
    if name in ("int", "integer") and kind in ("integer", "float", "string", "boolean"):
        strict = F.regexp_like(a.col, F.lit(r"^[+-]?\d+$")) if kind == "string" else F.lit(True)
        return F.when(strict, a.col.try_cast("bigint"))
    if name in ("float", "double", "real") and kind in ("integer", "float", "string", "boolean"):
        return a.col.try_cast("double")
    if name in ("string", "varchar") and kind in ("integer", "float", "string", "boolean"):
        return a.col.cast("string")
    if name == "boolean" and kind == "string":
        return F.when(F.lower(a.col) == "true", True).when(F.lower(a.col) == "false", False)
    if name == "boolean" and kind in ("integer", "boolean"):
        return a.col.cast("boolean")
    return F.lit(None).cast({"int": "bigint", "integer": "bigint", "float": "double", "double": "double", "real": "double", "boolean": "boolean"}.get(name, "string"))


def to_base(n: Arg, base: Arg) -> Column:
    digits = F.lower(F.call_function("conv", F.abs(n.col.cast("bigint")).cast("string"), F.lit(10), base.col.cast("int")))
    return F.when(n.col < 0, F.concat(F.lit("-"), digits)).otherwise(digits)


def from_base(s: Arg, base: Arg) -> Column:
    """Null for a text with a digit that the base lacks."""
    if not isinstance(base.literal, int) or not 2 <= base.literal <= 36:
        raise AnalysisError("a base must be a literal from 2 to 36")
    digits = "0123456789abcdefghijklmnopqrstuvwxyz"[: base.literal]
    body = F.regexp_replace(s.col, r"^[+-]", "")
    value = F.conv(body, base.literal, 10).cast("bigint")
    return F.when(F.regexp_like(s.col, F.lit(f"(?i)^[+-]?[{digits}]+$")), F.when(F.startswith(s.col, F.lit("-")), -value).otherwise(value))


def format_number(x: Arg, places: Arg) -> Column:
    if not isinstance(places.literal, int):
        raise AnalysisError("format_number takes a literal number of places")
    return F.format_string(f"%.{max(places.literal, 0)}f", x.col.cast("double"))


def register(r: Registry) -> None:
    r.register("typeof", typeof, 1)
    r.register("try_cast", try_cast, 2)
    r.register("to_base", to_base, 2)
    r.register("from_base", from_base, 2)
    r.register("format_number", lambda x, n: F.when(x.col.isNotNull(), format_number(x, n)), 2)

"""Steps of a path on a typed Column. What isn't there is MISSING, here a null."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F, types as T

from ..sources.json_lines import step as json_step
from ..sql import tree as t


@dataclass(frozen=True)
class Reached:
    """Where a path leads: a Column and its type, or MISSING (no Column)."""

    col: Column | None
    type: T.DataType | None


MISSING = Reached(None, None)


def walk(col: Column, kind: T.DataType, steps: tuple[t.Step, ...]) -> Reached:
    """Apply steps to a column; a wildcard maps the rest over elements or values."""
    for k, step in enumerate(steps):
        rest = steps[k + 1 :]
        if isinstance(step, t.Attr):
            if isinstance(kind, T.StructType) and step.name in kind.fieldNames():
                col, kind = col.getField(step.name), kind[step.name].dataType
            elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
                col, kind = F.try_element_at(col, F.lit(step.name)), kind.valueType
            else:
                return MISSING
        elif isinstance(step, t.Index):
            if not isinstance(kind, T.ArrayType):
                return MISSING
            col, kind = F.get(col, F.lit(step.at)), kind.elementType
        elif isinstance(step, t.Each):
            if not isinstance(kind, T.ArrayType):
                return MISSING
            return each(col, kind.elementType, rest)
        else:
            if isinstance(kind, T.StructType) and kind.fields:
                kinds = {f.dataType.simpleString() for f in kind.fields}
                same = kind.fields[0].dataType if len(kinds) == 1 else T.StringType()
                values = [col.getField(f.name) if len(kinds) == 1 else text(col.getField(f.name), f.dataType) for f in kind.fields]
                return each(F.when(col.isNotNull(), F.array(*values)), same, rest)
            if isinstance(kind, T.MapType):
                return each(F.map_values(col), kind.valueType, rest)
            return MISSING
    return Reached(col, kind)


def text(col: Column, kind: T.DataType) -> Column:
    return F.to_json(col) if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)) else col.cast("string")


def each(col: Column, kind: T.DataType, rest: tuple[t.Step, ...]) -> Reached:
    if not rest:
        return Reached(col, T.ArrayType(kind))
    inner = walk(F.lit(None).cast(kind), kind, rest)
    if inner.col is None:
        return MISSING
    return Reached(F.transform(col, lambda x: walk(x, kind, rest).col), T.ArrayType(inner.type))


def json_path(steps: tuple[t.Step, ...]) -> str | None:
    """The path in VARIANT terms; None if a step is a wildcard."""
    out = "$"
    for step in steps:
        if isinstance(step, t.Attr):
            out += json_step(step.name)
        elif isinstance(step, t.Index):
            out += f"[{step.at}]"
        else:
            return None
    return out

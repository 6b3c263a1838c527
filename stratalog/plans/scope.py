"""What names mean at a point of a query."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..errors import AnalysisError
from ..operators.paths import MISSING, Reached, json_path, walk
from ..sql import tree as t


@dataclass
class Relation:
    """A table of FROM: its columns by name, under the names they have in the DataFrame."""

    alias: str | None
    columns: dict[str, str]
    types: dict[str, T.DataType]
    variant: str | None = None  # the column that knows what is MISSING

    def struct(self) -> Reached:
        fields = [F.col(f"`{i}`").alias(n) for n, i in self.columns.items()]
        return Reached(F.struct(*fields), T.StructType([T.StructField(n, self.types[n]) for n in self.columns]))


@dataclass
class Scope:
    """Relations in reach, expressions that stand for columns, and the query around."""

    typing: DataFrame  # what types are asked of: no filter that may look outside
    relations: list[Relation]
    known: dict[t.Expr, str] = field(default_factory=dict)  # expressions that are columns
    aliases: dict[str, t.Expr] = field(default_factory=dict)  # output names, looked up last
    outer: Scope | None = None
    strict: bool = True
    depth: int = 0

    def type_of(self, col: Column) -> T.DataType:
        return self.typing.select(col).schema[0].dataType

    def find(self, path: t.Path) -> tuple[Relation, str, tuple[t.Step, ...]] | None:
        """The relation and column that a path starts from, and its other steps. Of columns of
        one name the last table's counts."""
        first, *rest = path.steps
        if rest and isinstance(rest[0], t.Attr):
            for relation in reversed(self.relations):
                if relation.alias == first.name and rest[0].name in relation.columns:
                    return relation, rest[0].name, tuple(rest[1:])
        for relation in reversed(self.relations):
            if first.name in relation.columns:
                return relation, first.name, tuple(rest)
        return None

    def reach(self, path: t.Path, inside: bool = True) -> Reached:
        """Where a path leads, looking outward; MISSING where a schema-free table may lack it."""
        if found := self.find(path):
            relation, name, rest = found
            col = F.col(f"`{relation.columns[name]}`")
            return walk(col if inside else col.outer(), relation.types[name], rest)
        for relation in self.relations:
            if relation.alias == path.steps[0].name:
                if len(path.steps) == 1:
                    return relation.struct()
                if relation.variant or not self.strict:
                    return MISSING
        if self.outer and (found := self.outer.reach_outward(path)):
            return found
        if not self.strict or any(r.variant for r in self.relations):
            return MISSING
        raise AnalysisError(f"unknown column {'.'.join(getattr(s, 'name', '[]') for s in path.steps)}")

    def reach_outward(self, path: t.Path) -> Reached | None:
        if self.find(path):
            return self.reach(path, inside=False)
        return self.outer.reach_outward(path) if self.outer else None

    def missing(self, path: t.Path) -> Column | bool:
        """Whether a path is MISSING: a Column where it depends on the row."""
        found = self.find(path)
        if not found:
            return self.reach(path).col is None
        relation, name, rest = found
        if not relation.variant:
            return self.reach(path).col is None
        steps = json_path((t.Attr(name), *rest))
        if steps is None:
            return self.reach(path).col is None
        variant = F.col(f"`{relation.variant}`")
        return variant.isNotNull() & F.try_variant_get(variant, steps, "variant").isNull()

"""Syntax tree of a query. Nodes are frozen, so equal text gives equal nodes."""

from __future__ import annotations

from dataclasses import dataclass


class Expr:
    """Any expression."""


@dataclass(frozen=True, eq=False)
class Literal(Expr):
    value: object  # None is NULL

    def __eq__(self, other: object) -> bool:  # 1, 1.0 and true are different literals
        return isinstance(other, Literal) and (type(self.value), self.value) == (type(other.value), other.value)

    def __hash__(self) -> int:
        return hash((type(self.value), self.value))


@dataclass(frozen=True)
class Missing(Expr):
    pass


@dataclass(frozen=True)
class Attr:
    name: str


@dataclass(frozen=True)
class Index:
    at: int


@dataclass(frozen=True)
class Each:
    """[*]: every element of an array."""


@dataclass(frozen=True)
class EachAttr:
    """.*: every value of an object."""


Step = Attr | Index | Each | EachAttr


@dataclass(frozen=True)
class Path(Expr):
    steps: tuple[Step, ...]

    @property
    def last_name(self) -> str | None:
        names = [s.name for s in self.steps if isinstance(s, Attr)]
        return names[-1] if names and isinstance(self.steps[-1], (Attr, Index)) else names[-1] if names else None


@dataclass(frozen=True)
class Unary(Expr):
    op: str
    operand: Expr


@dataclass(frozen=True)
class Binary(Expr):
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class IsTest(Expr):
    operand: Expr
    what: str  # null or missing
    negated: bool


@dataclass(frozen=True)
class Like(Expr):
    operand: Expr
    pattern: Expr
    negated: bool


@dataclass(frozen=True)
class InList(Expr):
    operand: Expr
    items: tuple[Expr, ...]
    negated: bool


@dataclass(frozen=True)
class Between(Expr):
    operand: Expr
    low: Expr
    high: Expr
    negated: bool


@dataclass(frozen=True)
class Case(Expr):
    branches: tuple[tuple[Expr, Expr], ...]
    otherwise: Expr | None


@dataclass(frozen=True)
class Cast(Expr):
    operand: Expr
    to: str


@dataclass(frozen=True)
class Star(Expr):
    pass


@dataclass(frozen=True)
class Order:
    key: Expr
    descending: bool


@dataclass(frozen=True)
class Call(Expr):
    name: str
    args: tuple[Expr, ...]
    within: Order | None = None
    distinct: bool = False


@dataclass(frozen=True)
class Scalar(Expr):
    query: Query


@dataclass(frozen=True)
class ArrayOf(Expr):
    items: tuple[Expr, ...]


@dataclass(frozen=True)
class TupleOf(Expr):
    items: tuple[tuple[str, Expr], ...]


@dataclass(frozen=True)
class Item:
    expr: Expr
    alias: str | None = None


@dataclass(frozen=True)
class Table:
    path: Path
    alias: str | None = None
    position: str | None = None  # AT


@dataclass(frozen=True)
class Join:
    kind: str  # cross, inner, left, right
    left: Table | Join
    right: Table
    on: Expr | None = None


@dataclass(frozen=True)
class Select:
    items: tuple[Item, ...]
    source: Table | Join
    value: Expr | None = None
    distinct: bool = False
    where: Expr | None = None
    keys: tuple[Item, ...] = ()
    group_as: str | None = None
    having: Expr | None = None
    order: tuple[Order, ...] = ()
    limit: int | None = None


@dataclass(frozen=True)
class SetOp:
    op: str  # union, intersect, except
    all: bool
    left: Query
    right: Query


Query = Select | SetOp

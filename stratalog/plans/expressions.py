"""Expressions of the tree to Columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F, types as T

from ..errors import AnalysisError
from ..functions import Arg, Registry
from ..functions.conversion import type_name
from ..operators.aggregates import NAMES as AGGREGATES
from ..sql import tree as t
from .scope import Scope

INFIX = {"+": "Plus", "-": "Minus", "*": "Times", "/": "Divide", "||": "Concat"}
COMPARE = {"=": "__eq__", "!=": "__ne__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}
CASTS = {"int": "bigint", "integer": "bigint", "bigint": "bigint", "float": "double", "double": "double", "varchar": "string", "string": "string", "boolean": "boolean", "bool": "boolean", "timestamp": "timestamp"}
#: Nodes that give a truth value whatever they hold.
TRUTH = (t.IsTest, t.Like, t.InList, t.Between)


class Expressions:
    """Compiles expressions in a scope. `subquery` turns a query into a scalar Column."""

    def __init__(self, functions: Registry, subquery: Callable[[t.Query, Scope], Column]):
        self._functions, self._subquery = functions, subquery

    def column(self, e: t.Expr, scope: Scope) -> Column:
        if e in scope.known:
            return F.col(f"`{scope.known[e]}`")
        return getattr(self, f"_{type(e).__name__.lower()}")(e, scope)

    def truth(self, e: t.Expr, scope: Scope) -> Column:
        """An expression as a condition: any value that isn't a truth value counts as true."""
        col = self.column(e, scope)
        if isinstance(e, TRUTH) or isinstance(e, t.Unary) and e.op == "not" or isinstance(e, t.Binary) and (e.op in COMPARE or e.op in ("and", "or")):
            return col
        kind = scope.type_of(col)
        if isinstance(kind, T.NullType):
            return F.lit(None).cast("boolean")
        return col if isinstance(kind, T.BooleanType) else col.isNotNull()

    def arg(self, e: t.Expr, scope: Scope) -> Arg:
        missing = None
        if isinstance(e, t.Path) and e not in scope.known:
            found = scope.missing(e)
            missing = F.lit(found) if isinstance(found, bool) and found else found if isinstance(found, Column) else None
        elif isinstance(e, t.Missing):
            missing = F.lit(True)
        return Arg(self.column(e, scope), scope.type_of, e.value if isinstance(e, t.Literal) else None, missing)

    def _literal(self, e: t.Literal, scope: Scope) -> Column:
        return F.lit(e.value).cast("bigint") if isinstance(e.value, int) and not isinstance(e.value, bool) else F.lit(e.value)

    def _missing(self, e: t.Missing, scope: Scope) -> Column:
        return F.lit(None)

    def _path(self, e: t.Path, scope: Scope) -> Column:
        if len(e.steps) == 1 and e.steps[0].name in scope.aliases and not scope.find(e):
            return self.column(scope.aliases[e.steps[0].name], scope)
        found = scope.reach(e)
        return F.lit(None) if found.col is None else found.col

    def _star(self, e: t.Star, scope: Scope) -> Column:
        raise AnalysisError("* stands only in SELECT and count(*)")

    def _unary(self, e: t.Unary, scope: Scope) -> Column:
        return ~self.truth(e.operand, scope) if e.op == "not" else -self.column(e.operand, scope)

    def _binary(self, e: t.Binary, scope: Scope) -> Column:
        if e.op in ("and", "or"):
            left, right = self.truth(e.left, scope), self.truth(e.right, scope)
            return left & right if e.op == "and" else left | right
        if e.op in COMPARE:
            return getattr(self.column(e.left, scope), COMPARE[e.op])(self.column(e.right, scope))
        return self._functions[INFIX[e.op]](self.arg(e.left, scope), self.arg(e.right, scope))

    def _istest(self, e: t.IsTest, scope: Scope) -> Column:
        missing = self._is_missing(e.operand, scope)
        if e.what == "missing":
            out = F.lit(missing) if isinstance(missing, bool) else missing
        elif missing is True:
            out = F.lit(False)
        else:
            null = self.column(e.operand, scope).isNull()
            out = null if missing is False else null & ~missing
        return ~out if e.negated else out

    def _is_missing(self, e: t.Expr, scope: Scope) -> Column | bool:
        if isinstance(e, t.Missing):
            return True
        return scope.missing(e) if isinstance(e, t.Path) and e not in scope.known else False

    def _like(self, e: t.Like, scope: Scope) -> Column:
        """% and _ only: a backslash is an ordinary character."""
        value = self.column(e.operand, scope)
        if isinstance(e.pattern, t.Literal) and isinstance(e.pattern.value, str):
            out = value.like(e.pattern.value.replace("\\", "\\\\"))
        else:
            out = F.like(value, F.replace(self.column(e.pattern, scope), F.lit("\\"), F.lit("\\\\")))
        return ~out if e.negated else out

    def _inlist(self, e: t.InList, scope: Scope) -> Column:
        out = self.column(e.operand, scope).isin(*(self.column(x, scope) for x in e.items))
        return ~out if e.negated else out

    def _between(self, e: t.Between, scope: Scope) -> Column:
        out = self.column(e.operand, scope).between(self.column(e.low, scope), self.column(e.high, scope))
        return ~out if e.negated else out

    def _case(self, e: t.Case, scope: Scope) -> Column:
        first, *rest = [(self.truth(c, scope), self.column(v, scope)) for c, v in e.branches]
        out = F.when(*first)
        for condition, value in rest:
            out = out.when(condition, value)
        return out.otherwise(self.column(e.otherwise, scope)) if e.otherwise is not None else out

    def _cast(self, e: t.Cast, scope: Scope) -> Column:
        return self.column(e.operand, scope).cast(CASTS[e.to])

    def _scalar(self, e: t.Scalar, scope: Scope) -> Column:
        return self._subquery(e.query, scope)

    def _arrayof(self, e: t.ArrayOf, scope: Scope) -> Column:
        return F.array(*(self.column(x, scope) for x in e.items))

    def _tupleof(self, e: t.TupleOf, scope: Scope) -> Column:
        return F.struct(*(self.column(x, scope).alias(k) for k, x in e.items))

    def _call(self, e: t.Call, scope: Scope) -> Column:
        name = e.name.lower()
        if name in AGGREGATES and name not in self._functions:
            raise AnalysisError(f"{e.name} can't stand here")
        if name == "coalesce":
            if not e.args:
                raise AnalysisError("coalesce takes arguments")
            return F.coalesce(*(self.column(x, scope) for x in e.args))
        if name == "nullif":
            if len(e.args) != 2:
                raise AnalysisError("nullif takes 2 arguments")
            return F.nullif(*(self.column(x, scope) for x in e.args))
        return self._functions[name](*(self.arg(x, scope) for x in e.args))


def default_name(e: t.Expr, at: int) -> str:
    """Output name of an expression without an alias."""
    name = e.last_name if isinstance(e, t.Path) else None
    return name or f"_{at}"


__all__ = ["Expressions", "default_name", "type_name"]

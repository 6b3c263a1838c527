"""Queries to DataFrames, clause by clause; planning and execution are Spark's."""

from __future__ import annotations

from dataclasses import fields, is_dataclass
from itertools import count

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..errors import AnalysisError
from ..functions import Registry
from ..operators import aggregates, setops
from ..sources import json_lines
from ..sources.tables import Tables
from ..sql import tree as t
from .expressions import Expressions, default_name
from .scope import Relation, Scope


def aggregate_calls(e: object, functions: Registry) -> list[t.Call]:
    """Aggregate calls in an expression, those of subqueries left out."""
    if isinstance(e, t.Call) and e.name.lower() in aggregates.NAMES and e.name.lower() not in functions:
        return [e]
    if isinstance(e, t.Scalar):
        return []
    if isinstance(e, tuple):
        return [c for x in e for c in aggregate_calls(x, functions)]
    if is_dataclass(e):
        return [c for f in fields(e) for c in aggregate_calls(getattr(e, f.name), functions)]
    return []


def place_read(df: DataFrame) -> Column:
    """Where a row of a table was read: by file, block and order there; for tables that are no
    files by partition and order."""
    order = F.monotonically_increasing_id().alias("row")
    in_file = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), order)
    try:
        df.select(in_file)
        return in_file
    except AnalysisException:
        return F.struct(F.lit("").alias("file"), F.lit(0).cast("bigint").alias("block"), order)


class Compiler:
    def __init__(self, tables: Tables, functions: Registry, strict: bool = True, large_groups: bool = False):
        self._tables, self._functions, self._strict, self._large_groups = tables, functions, strict, large_groups
        self._numbers = count()
        self._exprs = Expressions(functions, self._subquery)

    def compile(self, query: t.Query, outer: Scope | None = None) -> DataFrame:
        if isinstance(query, t.SetOp):
            return setops.combine(query.op, query.all, self.compile(query.left, outer), self.compile(query.right, outer))
        return self._select(query, outer)

    def _subquery(self, query: t.Query, scope: Scope) -> Column:
        """First column of the first row; null without one."""
        df = self.compile(query, scope)
        single = isinstance(query, t.Select) and not query.keys and aggregate_calls(query.items, self._functions)
        if not isinstance(query, t.Select) or len(query.items) != 1 or isinstance(query.items[0].expr, t.Star):
            df = df.select(f"`{df.columns[0]}`")
        return (df if single else df.limit(1)).scalar()

    # -- FROM -----------------------------------------------------------------------------------

    def _relation(self, df: DataFrame, alias: str | None, numbered: bool) -> tuple[DataFrame, Relation]:
        """df under names that no other table of the query has; numbered: with the place where
        each row was read."""
        k = next(self._numbers)
        alike = len({c.lower() for c in df.columns}) < len(df.columns)  # Spark doesn't tell case apart
        names = {c: f"{alias or 't'}_{k}_{c}" + (f"_{i}" if alike else "") for i, c in enumerate(df.columns)}
        types = {f.name: f.dataType for f in df.schema.fields}
        renamed = df.toDF(*names.values())
        if numbered:
            renamed = renamed.select("*", place_read(renamed).alias(f"{aggregates.SEQUENCE}_{k}"))
        variant = names.pop(json_lines.VARIANT, None)
        return renamed, Relation(alias, names, types, variant)

    def _table(self, table: t.Table, outer: Scope | None, numbered: bool) -> tuple[DataFrame, Relation]:
        first, *rest = table.path.steps
        df, relation = self._relation(self._tables[first.name], first.name if rest or not table.alias else table.alias, numbered)
        if not rest:
            if table.position:
                raise AnalysisError("AT needs a path in FROM")
            return df, relation
        if not table.alias:
            raise AnalysisError("a path in FROM needs an alias")
        scope = Scope(df, [relation], strict=False)
        found = scope.reach(t.Path((t.Attr(first.name), *rest)))
        k = next(self._numbers)
        names = {table.alias: f"{table.alias}_{k}_item"}
        if found.col is None:
            found = type(found)(F.lit(None).cast("string"), T.StringType())
        place = [F.col(c) for c in df.columns if c.startswith(f"{aggregates.SEQUENCE}_")]
        if isinstance(found.type, T.ArrayType):
            out = df.select(*place, F.posexplode(found.col).alias(f"_{k}_at", names[table.alias]))
            kind = found.type.elementType
        else:  # a scalar is one row without a position
            out = df.select(*place, F.lit(None).cast("int").alias(f"_{k}_at"), found.col.alias(names[table.alias]))
            kind = found.type
        types = {table.alias: kind}
        if table.position:
            names[table.position], types[table.position] = f"{table.alias}_{k}_at", T.LongType()
        place = [F.struct(c, f"_{k}_at").alias(c) for c in out.columns if c.startswith(f"{aggregates.SEQUENCE}_")]
        out = out.select(F.col(names[table.alias]), F.col(f"_{k}_at").cast("bigint").alias(f"{table.alias}_{k}_at"), *place)
        return out, Relation(None, names, types)

    def _source(self, source: t.Table | t.Join, outer: Scope | None, numbered: bool) -> tuple[DataFrame, list[Relation]]:
        if isinstance(source, t.Table):
            df, relation = self._table(source, outer, numbered)
            return df, [relation]
        left, relations = self._source(source.left, outer, numbered)
        right, relation = self._table(source.right, outer, numbered)
        relations = [*relations, relation]
        if source.kind == "cross":
            return left.crossJoin(right), relations
        scope = Scope(left.crossJoin(right), relations, outer=outer, strict=self._strict)
        return left.join(right, self._exprs.truth(source.on, scope), source.kind), relations

    # -- SELECT ---------------------------------------------------------------------------------

    def _select(self, q: t.Select, outer: Scope | None) -> DataFrame:
        items = self._items(q)
        calls = list(dict.fromkeys(aggregate_calls((tuple(i.expr for i in items), q.having, q.order), self._functions)))
        numbered = any(c.name.lower() in ("first", "last") for c in calls)
        df, relations = self._source(q.source, outer, numbered)
        scope = Scope(df, relations, outer=outer, strict=self._strict)
        if numbered:  # rows of a join come in the order of its left side, then of its right
            places = [c for c in df.columns if c.startswith(f"{aggregates.SEQUENCE}_")]
            df = df.select("*", F.struct(*places).alias(aggregates.SEQUENCE)).drop(*places)
            scope.typing = df
        if q.where is not None:
            df = df.where(self._exprs.truth(q.where, scope))
        if q.keys or calls or q.group_as:
            df, scope = self._grouped(q, items, calls, df, scope)
        elif q.having is not None:
            raise AnalysisError("HAVING needs GROUP BY or an aggregate")
        scope.aliases = {i.alias: i.expr for i in items if i.alias}
        if q.having is not None:
            df = df.where(self._exprs.truth(q.having, scope))
        outputs = self._outputs(items, scope)
        if q.distinct:
            df = df.select(*(c.alias(n) for n, c in outputs.items())).distinct()
            df = self._sorted(q, df, {n: F.col(f"`{n}`") for n in outputs}, scope, only_outputs=True)
        else:
            df = self._sorted(q, df, outputs, scope, only_outputs=False)
        return df if q.limit is None else df.limit(q.limit)

    @staticmethod
    def _items(q: t.Select) -> list[t.Item]:
        if q.value is None:
            return list(q.items)
        if isinstance(q.value, t.TupleOf):
            return [t.Item(x, k) for k, x in q.value.items]
        if isinstance(q.value, t.ArrayOf):
            return [t.Item(x) for x in q.value.items]
        return [t.Item(q.value, default_name(q.value, 0) if isinstance(q.value, t.Path) else "_value")]

    def _outputs(self, items: list[t.Item], scope: Scope) -> dict[str, Column]:
        """Columns by output name; of one name the last counts, at the first's place."""
        out: dict[str, Column] = {}
        for at, item in enumerate(items):
            if isinstance(item.expr, t.Star):
                for relation in scope.relations:
                    out |= {n: F.col(f"`{i}`") for n, i in relation.columns.items()}
            else:
                out[item.alias or default_name(item.expr, at + 1 if scope.known else at)] = self._exprs.column(item.expr, scope)
        return out

    def _grouped(self, q: t.Select, items: list[t.Item], calls: list[t.Call], df: DataFrame, scope: Scope) -> tuple[DataFrame, Scope]:
        k = next(self._numbers)
        known: dict[t.Expr, str] = {}
        columns: dict[str, str] = {}
        keys, before, aggs, ranked = [], [], [], []
        for at, key in enumerate(q.keys):
            name = f"g{k}_key{at}"
            expr = key.expr
            if isinstance(expr, t.Path) and len(expr.steps) == 1 and not scope.find(expr):  # an output's alias
                expr = next((i.expr for i in items if i.alias == expr.steps[0].name), expr)
            keys.append(self._exprs.column(expr, scope).alias(name))
            known[expr] = known[key.expr] = name
            columns[key.alias or default_name(key.expr, at + 1)] = name
        for at, call in enumerate(calls):
            name, arg = f"g{k}_agg{at}", f"g{k}_arg{at}"
            fn = call.name.lower()
            ordered = fn in aggregates.ORDERED
            if ordered != (call.within is not None) or len(call.args) != 1:
                raise AnalysisError(f"{fn} takes one argument{' and WITHIN GROUP' if ordered else ''}")
            value = call.within.key if ordered else call.args[0]
            if fn == "count" and isinstance(value, t.Star):
                aggs.append(aggregates.build("count", None).alias(name))
            else:
                col = self._exprs.column(value, scope)
                kind = scope.type_of(col) if fn in ("sum", "avg", "percentile_disc") else None
                before.append(col.alias(arg))
                share = call.args[0].value if ordered and isinstance(call.args[0], t.Literal) else None
                agg = aggregates.build(fn, arg, kind, share, ordered and call.within.descending, call.distinct).alias(name)
                if fn == "percentile_disc" and scope.outer is None and (self._large_groups or not aggregates.counted(kind)):
                    ranked.append((arg, float(share), call.within.descending, name))
                else:
                    aggs.append(agg)
            known[call] = name
        if q.group_as:
            name = f"g{k}_rows"
            every = {n: i for r in scope.relations for n, i in r.columns.items()}
            before += [F.col(f"`{i}`") for i in every.values()]
            aggs.append(aggregates.group_as(every).alias(name))
            columns[q.group_as] = name
        if any(c.name.lower() in ("first", "last") for c in calls):
            before.append(F.col(aggregates.SEQUENCE))

        def grouped(df: DataFrame) -> DataFrame:
            rows = df.select(*keys, *before)
            names = [f"g{k}_key{at}" for at in range(len(keys))]
            if not keys:  # a plain SELECT, so that an outer reference may wait for its query
                out = rows.select(*aggs or [F.count(F.lit(1)).alias(f"g{k}_n")])
            else:
                out = rows.groupBy(*names).agg(*aggs) if aggs else rows.select(*names).distinct()
            for arg, share, descending, name in ranked:
                own = aggregates.ranked_percentile(rows, names, arg, share, descending, name)
                alike = F.lit(True)
                for x in names:
                    own = own.withColumnRenamed(x, f"{name}_{x}")
                    alike = alike & F.col(x).eqNullSafe(F.col(f"{name}_{x}"))
                out = out.join(own, alike, "left").drop(*(f"{name}_{x}" for x in names))
            return out

        out, typing = grouped(df), grouped(scope.typing)
        types = {f.name: f.dataType for f in typing.schema.fields}
        relation = Relation(None, columns, {n: types[i] for n, i in columns.items()})
        return out, Scope(typing, [relation], known, outer=scope.outer, strict=scope.strict)

    def _sorted(self, q: t.Select, df: DataFrame, outputs: dict[str, Column], scope: Scope, only_outputs: bool) -> DataFrame:
        """Project to the outputs, in the order asked for: nulls last upward, first downward."""
        if not q.order:
            return df if only_outputs else df.select(*(c.alias(n) for n, c in outputs.items()))
        keys, extra = [], []
        for at, order in enumerate(q.order):
            path = order.key
            if isinstance(path, t.Path) and len(path.steps) == 1 and path.steps[0].name in outputs:
                col = F.col(f"`{path.steps[0].name}`")
            elif only_outputs:
                named = {i.expr: i.alias or default_name(i.expr, k) for k, i in enumerate(self._items(q))}
                if path not in named:
                    raise AnalysisError("with DISTINCT, ORDER BY takes output columns")
                col = F.col(f"`{named[path]}`")
            else:
                extra.append(self._exprs.column(path, scope).alias(f"_order{at}"))
                col = F.col(f"_order{at}")
            keys.append(col.desc_nulls_first() if order.descending else col.asc_nulls_last())
        if only_outputs:
            return df.orderBy(*keys)
        out = df.select(*(c.alias(n) for n, c in outputs.items()), *extra).orderBy(*keys)
        return out.select(*(f"`{n}`" for n in outputs)) if extra else out

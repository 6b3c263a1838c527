"""Aggregates of the dialect. All combine before the shuffle; none gathers a group's rows, save
`group_as`, and percentiles of texts in correlated subqueries."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..errors import AnalysisError

NAMES = frozenset("count sum avg min max first last approx_count_distinct percentile_disc approx_percentile".split())
#: Column with the place where a row was read, by which rows are ordered where `first` or `last`
#: asks for it.
SEQUENCE = "_sequence"
ORDERED = ("percentile_disc", "approx_percentile")
#: Greatest relative error of approx_count_distinct, and accuracy of approx_percentile.
DISTINCT_ERROR, PERCENTILE_ACCURACY = 0.05, 10_000


def percentile_disc(share: float, column: str, descending: bool, kind: T.DataType) -> Column:
    """The value at the 0-based place floor(n * share) of the group in order, nulls left out.

    That place, counted from the other end, is the one that the built-in percentile_disc
    takes for the rest of the share; the built-in keeps counts of values, not rows.
    """
    rest = float(1 - Decimal(str(share)))
    value = F.col(column)
    if rest <= 0:
        return F.min(value) if descending else F.max(value)
    back = "asc" if descending else "desc"
    if isinstance(kind, T.NumericType):
        return F.expr(f"percentile_disc({rest!r}) within group (order by `{column}` {back})").cast(kind)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        micros = F.expr(f"percentile_disc({rest!r}) within group (order by unix_micros(cast(`{column}` as timestamp)) {back})")
        return F.timestamp_micros(micros.cast("bigint")).cast(kind)
    ordered = F.sort_array(F.collect_list(value), asc=not descending)
    return F.get(ordered, F.least(F.floor(F.size(ordered) * F.lit(share)), F.size(ordered) - 1).cast("int"))


def counted(kind: T.DataType) -> bool:
    """Whether the built-in percentile takes values of the kind; it keeps counts of a group's
    different values in memory."""
    return isinstance(kind, (T.NumericType, T.TimestampType, T.TimestampNTZType))


def ranked_percentile(rows: DataFrame, keys: list[str], column: str, share: float, descending: bool, name: str) -> DataFrame:
    """(keys, name): percentile_disc of a column of any kind by group. Different values are
    counted before they move; a group's are then sorted, which spills, instead of gathered."""
    values = rows.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    order = group.orderBy(F.col(column).desc() if descending else F.col(column).asc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = values.select(*keys, column, "_n", F.sum("_n").over(order).alias("_to"), F.sum("_n").over(group).alias("_all"))
    place = F.least(F.floor(F.col("_all") * F.lit(share)), F.col("_all") - 1)
    return placed.where((place < F.col("_to")) & (place >= F.col("_to") - F.col("_n"))).select(*keys, F.col(column).alias(name))


def build(name: str, column: str | None, kind: T.DataType | None = None, share: object = None, descending: bool = False, distinct: bool = False) -> Column:
    """The aggregate of a column by name; no column means of rows."""
    value = F.col(column) if column else None
    if distinct and name not in ("count", "min", "max"):
        raise AnalysisError(f"{name} takes no DISTINCT")
    if name in ORDERED and (isinstance(share, bool) or not isinstance(share, (int, float)) or not 0 <= share <= 1):
        raise AnalysisError(f"{name} takes a literal share from 0 to 1")
    if name == "count":
        counted = F.count(F.lit(1)) if value is None else F.count_distinct(value) if distinct else F.count(value)
        return counted.cast("bigint")
    if value is None:
        raise AnalysisError(f"{name} takes an argument")
    if name in ("sum", "avg"):
        if not isinstance(kind, (T.NumericType, T.NullType)):
            raise AnalysisError(f"{name} takes numbers, not {kind.simpleString()}")
        return (F.sum if name == "sum" else F.avg)(value.cast("double"))
    if name in ("min", "max"):
        return (F.min if name == "min" else F.max)(value)
    if name in ("first", "last"):  # nulls count, so the value goes in a struct
        pick = F.min_by if name == "first" else F.max_by
        return pick(F.struct(value.alias("v")), F.col(SEQUENCE))["v"]
    if name == "approx_count_distinct":
        return F.approx_count_distinct(value, DISTINCT_ERROR)
    if name == "approx_percentile":
        return F.percentile_approx(value, float(share), PERCENTILE_ACCURACY)
    return percentile_disc(float(share), column, descending, kind)


def group_as(columns: dict[str, str]) -> Column:
    """The rows of a group as an array of structs. A group's rows must fit in memory."""
    return F.collect_list(F.struct(*(F.col(f"`{internal}`").alias(name) for name, internal in columns.items())))

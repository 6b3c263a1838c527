"""Set operations. Branches meet by column names where these agree, else by position."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..errors import AnalysisError


def lined_up(left: DataFrame, right: DataFrame) -> DataFrame:
    if sorted(left.columns) == sorted(right.columns):
        return right.select(*(f"`{c}`" for c in left.columns))
    if len(left.columns) != len(right.columns):
        raise AnalysisError(f"branches have {len(left.columns)} and {len(right.columns)} columns")
    return right.toDF(*left.columns)


def combine(op: str, every: bool, left: DataFrame, right: DataFrame) -> DataFrame:
    """UNION, INTERSECT or EXCEPT, with ALL if every."""
    if op == "union":
        if sorted(left.columns) != sorted(right.columns) and len(left.columns) != len(right.columns):
            out = left.unionByName(right, allowMissingColumns=True)
        else:
            out = left.union(lined_up(left, right))
        return out if every else out.distinct()
    right = lined_up(left, right)
    if op == "intersect":
        return left.intersectAll(right) if every else left.intersect(right)
    return left.exceptAll(right) if every else left.subtract(right)

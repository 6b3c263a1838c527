"""Regular expressions, found anywhere in the text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .registry import Arg, Registry


def extract(s: Arg, pattern: Arg, k: Arg | None = None) -> Column:
    """The group of the first match, the whole match by default; null without one."""
    group = k.col.cast("int") if k else F.lit(0)
    return F.when(F.regexp_like(s.col, pattern.col), F.call_function("regexp_extract", s.col, pattern.col, group))


def register(r: Registry) -> None:
    r.register("regexp_like", lambda s, p: F.regexp_like(s.col, p.col), 2)
    r.register("regexp_extract", extract, 2, 3)
    r.register("regexp_extract_all", lambda s, p: F.regexp_extract_all(s.col, p.col, F.lit(0)), 2)
    r.register("regexp_replace", lambda s, p, x: F.regexp_replace(s.col, p.col, x.col), 3)
    r.register("regexp_split", lambda s, p: F.call_function("split", s.col, p.col, F.lit(-1)), 2)
    r.register("regexp_count", lambda s, p: F.regexp_count(s.col, p.col).cast("bigint"), 2)

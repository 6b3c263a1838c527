"""Parts of host:port, as a log's struct or as text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .registry import Arg, Registry

_HOST = r"(?s)^(.*):(\d+)$"


def name(a: Arg) -> Column:
    return a.col["hostname"] if a.is_struct else F.when(F.regexp_like(a.col, F.lit(_HOST)), F.regexp_extract(a.col, _HOST, 1))


def port(a: Arg) -> Column:
    return (a.col["port"] if a.is_struct else F.try_to_number(F.nullif(F.regexp_extract(a.col, _HOST, 2), F.lit("")), F.lit("99999"))).cast("bigint")


def register(r: Registry) -> None:
    r.register("host_name", name, 1)
    r.register("host_port", port, 1)

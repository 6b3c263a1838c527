"""Dates and times, in UTC."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from ..errors import AnalysisError
from .registry import Arg, Registry

UNITS = ("second", "minute", "hour", "day")
_SECONDS = {"second": 1, "minute": 60, "hour": 3600}
_WITHIN = {"second": 60, "minute": 60, "hour": 24}
PARTS = {
    "year": F.year,
    "quarter": F.quarter,
    "month": F.month,
    "week": F.weekofyear,
    "day": F.day,
    "hour": F.hour,
    "minute": F.minute,
    "second": F.second,
}


def interval(text: object) -> tuple[int, str]:
    """A length such as `5 seconds`; plural for more than one, and only then."""
    m = re.fullmatch(r"\s*(\d+)\s+(second|minute|hour|day|week|month|year)(s?)\s*", text) if isinstance(text, str) else None
    if not m or (int(m[1]) > 1) != bool(m[3]):
        raise AnalysisError(f"not a time interval: {text!r}")
    return int(m[1]), m[2]


def time_bucket(width: Arg, ts: Arg) -> Column:
    """Start of the bucket that ts lies in; the width must divide the next larger unit."""
    n, unit = interval(width.literal)
    if unit not in _SECONDS or n == 0 or _WITHIN[unit] % n:
        raise AnalysisError(f"time_bucket can't use {width.literal!r}")
    seconds = n * _SECONDS[unit]
    stamp = ts.col.cast("timestamp")
    return F.timestamp_seconds(F.floor(F.unix_seconds(stamp) / seconds) * seconds)


def part(unit: Arg, ts: Arg) -> Column:
    return PARTS[unit.word("date part", PARTS)](ts.col).cast("double")


def add(unit: Arg, n: Arg, ts: Arg) -> Column:
    return F.timestamp_add(unit.word("unit", UNITS).upper(), n.col.cast("int"), ts.col.cast("timestamp"))


def diff(unit: Arg, start: Arg, end: Arg) -> Column:
    return F.timestamp_diff(unit.word("unit", UNITS).upper(), start.col.cast("timestamp"), end.col.cast("timestamp"))


def register(r: Registry) -> None:
    r.register("date_part", part, 2)
    r.register("time_bucket", time_bucket, 2)
    for name, build in (*((x, PARTS[x]) for x in ("year", "month", "day", "hour", "minute", "second", "quarter", "week")), ("day_of_year", F.dayofyear)):
        r.register(name, lambda ts, build=build: build(ts.col).cast("bigint"), 1)
    r.register("millisecond", lambda ts: F.pmod(F.unix_millis(ts.col.cast("timestamp")), F.lit(1000)), 1)
    r.register("day_of_week", lambda ts: (F.weekday(ts.col) + 1).cast("bigint"), 1)
    r.register("date_add", add, 3)
    r.register("date_diff", diff, 3)
    r.register("date_trunc", lambda unit, ts: F.date_trunc(unit.word("unit", UNITS), ts.col.cast("timestamp")), 2)
    r.register("from_unixtime", lambda n: F.timestamp_seconds(n.col), 1)
    r.register("to_unixtime", lambda ts: F.unix_seconds(ts.col.cast("timestamp")), 1)
    r.register("now", F.current_timestamp, 0)

"""Bits of integers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from .registry import Arg, Registry


def bit_count(a: Arg) -> Column:
    narrow = isinstance(a.type, (T.IntegerType, T.ShortType, T.ByteType))
    return F.bit_count(a.col.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)) if narrow else a.col).cast("bigint")


def register(r: Registry) -> None:
    r.register("bitwise_and", lambda a, b: a.col.bitwiseAND(b.col), 2)
    r.register("bitwise_or", lambda a, b: a.col.bitwiseOR(b.col), 2)
    r.register("bitwise_xor", lambda a, b: a.col.bitwiseXOR(b.col), 2)
    r.register("bitwise_not", lambda a: F.bitwise_not(a.col), 1)
    r.register("bit_count", bit_count, 1)
    r.register("bitwise_shift_left", lambda a, n: F.call_function("shiftleft", a.col, n.col.cast("int")), 2)
    r.register("bitwise_shift_right", lambda a, n: F.call_function("shiftright", a.col, n.col.cast("int")), 2)

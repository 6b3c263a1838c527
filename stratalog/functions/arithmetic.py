"""Arithmetic and mathematics. Integers are 64 bits wide, fractions are doubles."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .registry import Arg, Registry


def divide(a: Arg, b: Arg) -> Column:
    """Whole quotient of integers, null by zero; IEEE division otherwise."""
    if a.integral and b.integral:
        return F.call_function("div", a.col, F.nullif(b.col, F.lit(0)))
    x, y = a.col.cast("double"), b.col.cast("double")
    by_zero = F.when(x > 0, F.lit(float("inf"))).when(x < 0, F.lit(float("-inf"))).when(x == 0, F.lit(float("nan")))
    return F.when(y == 0, F.when(F.isnan(x), F.lit(float("nan"))).otherwise(by_zero)).otherwise(F.try_divide(x, y))


def modulo(a: Arg, b: Arg) -> Column:
    if a.integral and b.integral:
        return F.try_mod(a.col, b.col)
    x, y = a.col.cast("double"), b.col.cast("double")
    return F.when(y == 0, F.lit(float("nan"))).otherwise(F.try_mod(x, y))


def whole(build):
    return lambda a: build(a.col.cast("double")).cast("bigint") if not a.integral else a.col


def rounded(a: Arg, places: Arg | None = None) -> Column:
    if places is None:
        return F.round(a.col).cast("bigint")
    return F.round(a.col.cast("double"), places.literal if isinstance(places.literal, int) else places.col)


def sign(a: Arg) -> Column:
    return F.sign(a.col).cast("bigint") if a.integral else F.sign(a.col)


def logarithm(build):
    """Spark gives null outside the domain; IEEE gives minus infinity at 0 and NaN below."""
    return lambda a: F.when(a.col > 0, build(a.col)).when(a.col == 0, F.lit(float("-inf"))).when(a.col < 0, F.lit(float("nan"))).otherwise(build(a.col))


def of_double(build):
    return lambda *args: build(*(a.col.cast("double") for a in args))


def register(r: Registry) -> None:
    r.register("Plus", lambda a, b: a.col + b.col, 2)
    r.register("Minus", lambda a, b: a.col - b.col, 2)
    r.register("Times", lambda a, b: a.col * b.col, 2)
    r.register("Divide", divide, 2)
    r.register("abs", lambda a: F.abs(a.col), 1)
    for name in ("ceil", "ceiling"):
        r.register(name, whole(F.ceil), 1)
    r.register("floor", whole(F.floor), 1)
    r.register("round", rounded, 1, 2)
    r.register("sqrt", of_double(F.sqrt), 1)
    r.register("sign", sign, 1)
    for name in ("truncate", "trunc"):
        r.register(name, lambda a: a.col.cast("bigint"), 1)
    r.register("ln", logarithm(F.ln), 1)
    r.register("log2", logarithm(F.log2), 1)
    r.register("log10", logarithm(F.log10), 1)
    r.register("exp", of_double(F.exp), 1)
    for name in ("power", "pow"):
        r.register(name, of_double(F.pow), 2)
    for name in ("mod", "modulus"):
        r.register(name, modulo, 2)
    r.register("atan2", of_double(F.atan2), 2)
    r.register("pi", F.pi, 0)
    r.register("e", F.e, 0)
    r.register("infinity", lambda: F.lit(float("inf")), 0)
    r.register("nan", lambda: F.lit(float("nan")), 0)
    r.register("is_nan", of_double(lambda x: F.when(x.isNotNull(), F.isnan(x))), 1)
    r.register("is_finite", of_double(lambda x: ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))), 1)
    r.register("is_infinite", of_double(lambda x: F.abs(x) == F.lit(float("inf"))), 1)
    for name in ("radians", "degrees", "sin", "cos", "tan", "asin", "acos", "atan", "cosh", "tanh"):
        r.register(name, of_double(getattr(F, name)), 1)
    for name in ("rand", "random"):
        r.register(name, F.rand, 0)

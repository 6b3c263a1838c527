"""Strings."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .registry import Arg, Registry

SPACE = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def substring(s: Arg, start: Arg, length: Arg | None = None) -> Column:
    """1-based; a start under 1 counts as 1, a length under 0 as 0."""
    at = F.greatest(start.col.cast("int"), F.lit(1))
    n = F.greatest(length.col.cast("int"), F.lit(0)) if length else F.lit(2**31 - 1)
    return F.substring(s.col, at, n)


def trimmed(pattern: str, of_chars):
    """Without white space of any kind, or without any of the given characters."""
    return lambda s, chars=None: of_chars(s.col, chars.col) if chars else F.regexp_replace(s.col, pattern, "")


def padded(name: str):
    def build(s: Arg, size: Arg, pad: Arg | None = None) -> Column:
        return F.call_function(name, s.col, F.greatest(size.col.cast("int"), F.lit(0)), pad.col if pad else F.lit(" "))

    return build


def literal_pattern(text: Column) -> Column:
    return F.concat(F.lit(r"\Q"), F.replace(text, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def split(s: Arg, by: Arg) -> Column:
    """At each occurrence of a plain text."""
    return F.call_function("split", s.col, literal_pattern(by.col), F.lit(-1))


def split_part(s: Arg, by: Arg, at: Arg) -> Column:
    """1-based part; empty beyond either end."""
    i = at.col.cast("int")
    return F.when(i < 1, F.lit("")).otherwise(F.split_part(s.col, by.col, F.greatest(i, F.lit(1))))


def chr_(n: Arg) -> Column:
    """The character of any code point; null where there is none."""
    valid = n.col.between(0, 0x10FFFF) & ~n.col.between(0xD800, 0xDFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(n.col.cast("bigint")), 8, "0")), "UTF-32"))


def codepoint(s: Arg) -> Column:
    return F.when(F.char_length(s.col) == 1, F.ascii(s.col).cast("bigint"))


def hamming(a: Arg, b: Arg) -> Column:
    """Places that differ; null for texts of different length."""
    x, y = F.split(a.col, ""), F.split(b.col, "")
    differ = F.aggregate(F.zip_with(x, y, lambda p, q: (p != q).cast("int")), F.lit(0), lambda n, d: n + d).cast("bigint")
    return F.when(F.char_length(a.col) == F.char_length(b.col), F.when(F.char_length(a.col) == 0, F.lit(0)).otherwise(differ))


def register(r: Registry) -> None:
    r.register("Concat", lambda a, b: F.concat(a.col, b.col), 2)
    r.register("upper", lambda s: F.upper(s.col), 1)
    r.register("lower", lambda s: F.lower(s.col), 1)
    for name in ("char_length", "character_length"):
        r.register(name, lambda s: F.char_length(s.col).cast("bigint"), 1)
    r.register("substring", substring, 2, 3)
    r.register("trim", trimmed(f"^{SPACE}|{SPACE}$", F.btrim), 1, 2)
    r.register("ltrim", trimmed(f"^{SPACE}", F.ltrim), 1, 2)
    r.register("rtrim", trimmed(f"{SPACE}$", F.rtrim), 1, 2)
    r.register("replace", lambda s, a, b: F.replace(s.col, a.col, b.col), 3)
    r.register("reverse", lambda s: F.reverse(s.col), 1)
    r.register("repeat", lambda s, n: F.repeat(s.col, n.col.cast("int")), 2)
    r.register("lpad", padded("lpad"), 2, 3)
    r.register("rpad", padded("rpad"), 2, 3)
    for name in ("position", "strpos"):
        r.register(name, lambda s, x: F.call_function("instr", s.col, x.col).cast("bigint"), 2)
    r.register("starts_with", lambda s, x: F.startswith(s.col, x.col), 2)
    r.register("ends_with", lambda s, x: F.endswith(s.col, x.col), 2)
    r.register("split", split, 2)
    r.register("split_part", split_part, 3)
    r.register("concat_ws", lambda by, *rest: F.call_function("concat_ws", by.col, *(x.col.cast("string") for x in rest)), 2, None)
    r.register("chr", chr_, 1)
    r.register("codepoint", codepoint, 1)
    r.register("levenshtein_distance", lambda a, b: F.levenshtein(a.col, b.col).cast("bigint"), 2)
    r.register("hamming_distance", hamming, 2)

"""Parts of the URL of a request, or of a text that is a URL. What isn't one gives null."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .registry import Arg, Registry

_URL = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)(?::(\d*))?([^?#]*)(\?[^#]*)?(#.*)?$"
# Ports that a URL of the scheme leaves out.
_USUAL = {"http": "80", "https": "443", "ws": "80", "wss": "443", "ftp": "21"}


def url_of(a: Arg) -> Column:
    return a.col["url"] if a.is_struct else a.col


def group(a: Arg, k: int) -> Column:
    """The k-th part; empty where it is, and where the text is no URL."""
    return F.regexp_extract(url_of(a), _URL, k)


def port(a: Arg) -> Column:
    found, scheme = group(a, 3), F.lower(group(a, 1))
    usual = F.lit(None).cast("string")
    for name, number in _USUAL.items():
        usual = F.when(scheme == name, F.lit(number)).otherwise(usual)
    return F.when((found != "") & ~found.eqNullSafe(usual), found.cast("bigint"))


def path(a: Arg) -> Column:
    """A URL without a path has `/`; every URL has a scheme."""
    found = group(a, 4)
    return F.when(found != "", found).when(group(a, 1) != "", F.lit("/"))


def segments(a: Arg) -> Column:
    return F.split(F.substring(path(a), F.lit(2), F.lit(2**31 - 1)), "/", -1)


def bucket(a: Arg, at: Arg, target: Arg) -> Column:
    """The path with the 0-based segment replaced."""
    parts = F.transform(segments(a), lambda s, i: F.when(i == at.col, target.col).otherwise(s))
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


def after_mark(a: Arg, k: int) -> Column:
    found = group(a, k)
    return F.when(found != "", F.substring(found, F.lit(2), F.lit(2**31 - 1)))


def register(r: Registry) -> None:
    r.register("url_host", lambda a: F.lower(F.nullif(group(a, 2), F.lit(""))), 1)
    r.register("url_port", port, 1)
    r.register("url_path", path, 1)
    r.register("url_fragment", lambda a: after_mark(a, 6), 1)
    r.register("url_query", lambda a: after_mark(a, 5), 1)
    r.register("url_path_segments", lambda a, at: F.get(segments(a), at.col.cast("int")), 2)
    r.register("url_path_bucket", bucket, 3)

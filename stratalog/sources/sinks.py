"""Results as table, CSV or JSON text, streamed row by row; or written by the cluster."""

from __future__ import annotations

import csv
import datetime
import decimal
import json
import tempfile
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Row

from ..errors import EngineError

MODES = ("table", "csv", "json")
NULL, OBJECT, ARRAY = "<null>", "{...}", "[...]"


def moment(value: datetime.datetime) -> str:
    text = value.strftime("%Y-%m-%d %H:%M:%S")
    return text + (f".{value.microsecond:06d}".rstrip("0") if value.microsecond else "") + " +00:00"


def special(value: object) -> str | None:
    """A host as host:port, a request as its text; None for any other struct."""
    if isinstance(value, Row):
        names = value.__fields__
        if names == ["hostname", "port"]:
            return f"{value['hostname']}:{value['port']}"
        if names == ["http_method", "url", "http_version", "raw"]:
            return value["raw"]
    return None


def cell(value: object) -> str:
    if value is None:
        return NULL
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, datetime.datetime):
        return moment(value)
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e16:
        return str(int(value))
    if isinstance(value, (Row, dict)) or type(value).__name__ == "VariantVal":
        return special(value) or OBJECT
    return ARRAY if isinstance(value, list) else str(value)


def plain(value: object) -> object:
    """A value for JSON; structs, maps and arrays keep their nesting."""
    if isinstance(value, datetime.datetime):
        return moment(value)
    if isinstance(value, Row):
        return special(value) or {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(x) for x in value]
    if isinstance(value, decimal.Decimal):
        return float(value)
    if type(value).__name__ == "VariantVal":
        return json.loads(value.toJson())
    return value if value is None or isinstance(value, (bool, int, float, str)) else str(value)


def grid(rows: Iterable[list[str]]) -> Iterator[str]:
    """Cells in a frame, without a header. Rows wait in a temporary file of the driver until
    the widths are known, so they need not fit in memory."""
    widths: list[int] = []
    with tempfile.TemporaryFile("w+", encoding="utf-8") as held:
        for row in rows:
            lines = [c.split("\n") for c in row]
            held.write(json.dumps(lines) + "\n")
            own = [max(map(len, c)) for c in lines]
            widths = [max(x) for x in zip(widths, own)] if widths else own
        held.seek(0)
        rule = "+" + "".join("-" * (w + 2) + "+" for w in widths)
        for line in held:
            row = json.loads(line)
            yield rule
            for k in range(max(map(len, row))):
                yield "|" + "|".join(f" {(c[k] if k < len(c) else ''):<{w}} " for c, w in zip(row, widths)) + "|"
    if widths:
        yield rule


def show(df: DataFrame, mode: str, out) -> None:
    """Print a result; the driver holds one partition at a time."""
    if mode == "table":
        for line in grid([cell(v) for v in row] for row in df.toLocalIterator()):
            print(line, file=out)
    elif mode == "csv":
        writer = csv.writer(out, lineterminator="\n")
        for row in df.toLocalIterator():
            writer.writerow([cell(v) for v in row])
    elif mode == "json":
        out.write("[")
        for k, row in enumerate(df.toLocalIterator()):
            out.write(("," if k else "") + json.dumps({name: plain(v) for name, v in zip(df.columns, row)}, ensure_ascii=False))
        out.write("]\n")
    else:
        raise EngineError(f"unknown output {mode}; known are {', '.join(MODES)}")


def write(df: DataFrame, fmt: str, path: str, **options: str) -> None:
    """Write a result from the executors; CSV has no header and `<null>` for null."""
    if fmt == "csv":
        options = {"nullValue": NULL} | options
    df.write.format(fmt).options(**options).save(path)

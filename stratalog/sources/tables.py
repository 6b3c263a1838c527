"""Named tables, and the `name:format=path` text that registers one."""

from __future__ import annotations

import re
import sys

from pyspark.sql import DataFrame, SparkSession

from ..errors import SourceError
from . import json_lines, logs

FORMATS = (*logs.FIELDS, "jsonl", "parquet", "csv", "orc")


class Tables:
    """Tables by name; names are told apart by case."""

    def __init__(self, spark: SparkSession):
        self._spark = spark
        self._tables: dict[str, DataFrame] = {}

    def add(self, name: str, df: DataFrame) -> None:
        if not re.fullmatch(r"[A-Za-z0-9_]+", name):
            raise SourceError(f"not a table name: {name}")
        if name in self._tables:
            raise SourceError(f"table {name} is registered already")
        self._tables[name] = df

    def add_spec(self, spec: str, mode: str = "PERMISSIVE", stdin=None, schema: str | None = None) -> None:
        """Register `name:format=path`; the path may be `stdin`, glob and be compressed. A
        schema saves JSON lines the pass that finds their types."""
        m = re.fullmatch(r"([^:=]+):([^:=]+)=(.+)", spec)
        if not m:
            raise SourceError(f"not name:format=path: {spec}")
        name, fmt, path = m[1], m[2].lower(), m[3]
        if fmt not in FORMATS:
            raise SourceError(f"unknown format {fmt}; known are {', '.join(FORMATS)}")
        self.add(name, self._lines(fmt, (stdin or sys.stdin).read().splitlines(), mode) if path == "stdin" else self._read(fmt, path, mode, schema))

    def _lines(self, fmt: str, lines: list[str], mode: str) -> DataFrame:
        df = self._spark.createDataFrame([(x,) for x in lines], "value string")
        if fmt in logs.FIELDS:
            return logs.parse(df, fmt, mode=mode)
        if fmt == "jsonl":
            return json_lines.parse(df)
        raise SourceError(f"{fmt} can't be read from stdin")

    def _read(self, fmt: str, path: str, mode: str, schema: str | None) -> DataFrame:
        try:
            if fmt in logs.FIELDS:
                return logs.read(self._spark, fmt, path, mode)
            if fmt == "jsonl":
                return json_lines.read(self._spark, path, schema)
            if fmt == "csv":
                return self._spark.read.option("header", True).csv(path)
            return self._spark.read.format(fmt).load(path)
        except Exception as e:
            raise SourceError(f"can't read {path}: {str(e).splitlines()[0]}") from e

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._tables:
            raise SourceError(f"unknown table {name}")
        return self._tables[name]

    def __contains__(self, name: str) -> bool:
        return name in self._tables

"""The engine: tables and functions in, query text in, DataFrames out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

from .functions import Registry, builtin
from .plans.compiler import Compiler
from .session import prepared, session
from .sources.tables import Tables
from .sql.parser import parse


class Engine:
    """Queries over registered tables.

    With strict=False an unknown column of a typed table is MISSING; otherwise it is an error.
    With large_groups=True percentile_disc sorts a group's different numbers, which spills,
    instead of counting them in memory.
    """

    def __init__(self, spark: SparkSession | None = None, strict: bool = True, large_groups: bool = False):
        self.spark = prepared(spark) if spark else session()
        self.tables = Tables(self.spark)
        self.functions: Registry = builtin()
        self._strict, self._large_groups = strict, large_groups

    def table(self, name: str, df: DataFrame) -> Engine:
        """Register a DataFrame."""
        self.tables.add(name, df)
        return self

    def source(self, spec: str, mode: str = "PERMISSIVE", schema: str | None = None) -> Engine:
        """Register `name:format=path`; JSON lines may come with a schema."""
        self.tables.add_spec(spec, mode, schema=schema)
        return self

    def function(self, name: str, build: Callable[..., Column], least: int, most: int | None | str = "same") -> Engine:
        """Register a function of Columns, such as a pandas UDF."""
        self.functions.register_columns(name, build, least, most)
        return self

    def sql(self, text: str) -> DataFrame:
        return Compiler(self.tables, self.functions, self._strict, self._large_groups).compile(parse(text))

    def explain(self, text: str, mode: str = "formatted") -> str:
        """Spark's plan of a query."""
        df = self.sql(text)
        return self.spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


def connect(spark: SparkSession | None = None, strict: bool = True, large_groups: bool = False) -> Engine:
    return Engine(spark, strict, large_groups)

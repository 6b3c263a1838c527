"""Names, arities and builders of scalar functions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache
from importlib import import_module

from pyspark.sql import Column, types as T

from ..errors import AnalysisError

MODULES = ("arithmetic", "array", "bitwise", "string", "url", "host", "datetime", "regexp", "json", "map", "conversion")


class Arg:
    """An argument: its Column, its type (asked of Spark when needed), its literal value."""

    def __init__(self, col: Column, type_of: Callable[[Column], T.DataType], literal: object = None, missing: Column | None = None):
        self.col, self._type_of, self.literal, self.missing = col, type_of, literal, missing
        self._type: T.DataType | None = None

    @property
    def type(self) -> T.DataType:
        if self._type is None:
            self._type = self._type_of(self.col)
        return self._type

    @property
    def integral(self) -> bool:
        return isinstance(self.type, (T.IntegerType, T.LongType, T.ShortType, T.ByteType))

    @property
    def is_array(self) -> bool:
        return isinstance(self.type, T.ArrayType)

    @property
    def is_struct(self) -> bool:
        return isinstance(self.type, T.StructType)

    @property
    def is_map(self) -> bool:
        return isinstance(self.type, T.MapType)

    def word(self, what: str, allowed) -> str:
        """The literal, which must be one of the allowed words."""
        if not isinstance(self.literal, str) or self.literal not in allowed:
            raise AnalysisError(f"{what} must be one of {', '.join(sorted(allowed))}")
        return self.literal


@dataclass(frozen=True)
class Function:
    name: str
    least: int
    most: int | None  # None: any number
    build: Callable[..., Column]

    def accepts(self, n: int) -> bool:
        """Whether the function takes n arguments."""
        return self.least <= n and (self.most is None or n <= self.most)

    def __call__(self, *args: Arg) -> Column:
        if not self.accepts(len(args)):
            takes = f"{self.least}" if self.least == self.most else f"{self.least} or more" if self.most is None else f"{self.least} to {self.most}"
            raise AnalysisError(f"{self.name} takes {takes} arguments, not {len(args)}")
        return self.build(*args)


@dataclass
class Registry:
    """Functions by name, whatever the case; a name is registered once."""

    functions: dict[str, Function] = field(default_factory=dict)

    def register(self, name: str, build: Callable[..., Column], least: int, most: int | None | str = "same") -> None:
        key = name.lower()
        if key in self.functions:
            raise AnalysisError(f"function {name} is registered already")
        self.functions[key] = Function(name, least, least if most == "same" else most, build)

    def register_columns(self, name: str, build: Callable[..., Column], least: int, most: int | None | str = "same") -> None:
        """Register a function of Columns, such as a pandas UDF."""
        self.register(name, lambda *args: build(*(a.col for a in args)), least, most)

    def __getitem__(self, name: str) -> Function:
        try:
            return self.functions[name.lower()]
        except KeyError:
            raise AnalysisError(f"unknown function {name}") from None

    def __contains__(self, name: str) -> bool:
        return name.lower() in self.functions

    def copy(self) -> Registry:
        return Registry(dict(self.functions))


@lru_cache(1)
def _all() -> Registry:
    registry = Registry()
    for module in MODULES:
        import_module(f"stratalog.functions.{module}").register(registry)
    return registry


def builtin() -> Registry:
    """A registry of all built-in functions, free to be added to."""
    return _all().copy()

"""Scalar functions of the dialect, each a builder of Columns."""

from .registry import Arg, Function, Registry, builtin

__all__ = ["Arg", "Function", "Registry", "builtin"]

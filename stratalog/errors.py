"""Errors of the engine."""


class EngineError(Exception):
    """Any error that the engine raises itself."""


class QuerySyntaxError(EngineError):
    """The query text can't be parsed."""


class AnalysisError(EngineError):
    """The query names something that isn't there, or calls it wrongly."""


class SourceError(EngineError):
    """A table can't be registered or read."""


class ExecutionError(EngineError):
    """Spark failed while it ran a query."""

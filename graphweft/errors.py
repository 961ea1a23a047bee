"""Errors of the engine. Those of the query text carry the span (start, end) that they are about."""

from __future__ import annotations


class GraphError(Exception):
    """kind names the error; span is None where no query text is at fault."""

    def __init__(self, kind: str, message: str = "", span: tuple[int, int] | None = None):
        super().__init__(f"{kind}: {message}" if message else kind)
        self.kind, self.span = kind, span


class LexError(GraphError):
    pass


class ParseError(GraphError):
    pass


class QueryError(GraphError):
    pass


class PlanError(GraphError):
    pass


class ExecError(GraphError):
    pass


class AlgorithmError(GraphError, ValueError):
    pass


class TransactionError(GraphError):
    pass

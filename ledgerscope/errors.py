"""Typed errors, raised while a query is being built, before any job starts."""


class AnalysisInputError(ValueError):
    """A request that the table cannot answer."""


class SourceError(AnalysisInputError):
    """The dataset cannot be read."""


class ColumnError(AnalysisInputError):
    """A column is missing or has the wrong type."""


class OperationError(AnalysisInputError):
    """An unknown operator, aggregation or chart type."""


class LiteralError(AnalysisInputError):
    """A filter value that cannot be ordered against its column."""


class PeriodError(AnalysisInputError):
    """A period text that names no year or month."""


class EmptyResultError(AnalysisInputError):
    """No rows are left although the caller asked for at least one."""

"""Errors that callers can tell apart."""


class QueryError(ValueError):
    """A query that names something unknown or makes no sense."""


class Forbidden(PermissionError):
    """A scope doesn't allow an operation, or a written row leaves its filter."""


class MissingParam(QueryError):
    """A scope needs a request parameter that wasn't given."""


class NotFound(LookupError):
    """No row matches."""


class Referenced(QueryError):
    """A row can't be deleted as another one refers to it."""

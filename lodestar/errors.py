"""Errors of the engine: one hierarchy."""


class EngineError(Exception):
    """Any error raised here on purpose."""


class ValidationError(EngineError, ValueError):
    """An argument is not acceptable."""


class DimensionMismatchError(ValidationError):
    """A vector has another number of components than its collection."""


class DuplicateIdError(EngineError, ValueError):
    """An id exists already."""


class NotFoundError(EngineError, KeyError):
    """An id or a collection doesn't exist."""


class CollectionExistsError(EngineError, ValueError):
    """A collection of that name exists already."""


class StorageError(EngineError, OSError):
    """A saved database can't be read."""


class QuerySyntaxError(EngineError, ValueError):
    """A query or filter can't be understood."""


class CapacityError(EngineError, ValueError):
    """A collection would hold more rows than it may."""


class QueryTimeout(EngineError, TimeoutError):
    """A query ran longer than it may."""

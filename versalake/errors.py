"""Errors of the engine. All derive from `VersalakeError` and from the nearest built-in class."""


class VersalakeError(Exception):
    pass


class InvalidCondition(VersalakeError, ValueError):
    """A filter condition, connector or aggregate request that isn't legal."""


class ExpressionError(VersalakeError, ValueError):
    """An expression that doesn't parse or uses something that isn't allowed."""


class UnknownColumn(VersalakeError, KeyError):
    pass


class ColumnExists(VersalakeError, ValueError):
    pass


class TypeMismatch(VersalakeError, TypeError):
    """Values that don't fit a column's type, or a type that breaks its kind's constraint."""


class DatasetExists(VersalakeError, ValueError):
    pass


class DatasetNotFound(VersalakeError, FileNotFoundError):
    pass


class ReadOnly(VersalakeError, PermissionError):
    pass


class NotAuthorized(VersalakeError, PermissionError):
    pass


class TooLarge(VersalakeError, ValueError):
    """An action on much data that needs an explicit yes."""


class EmptyCommit(VersalakeError, ValueError):
    pass


class CheckoutError(VersalakeError, ValueError):
    pass


class UnknownCommit(VersalakeError, KeyError):
    pass


class UncommittedChanges(VersalakeError, ValueError):
    pass


class MergeConflict(VersalakeError, ValueError):
    pass


class MergeMismatch(VersalakeError, TypeError):
    pass


class IndexMissing(VersalakeError, KeyError):
    pass


class IndexExists(VersalakeError, ValueError):
    pass


class ViewNotFound(VersalakeError, KeyError):
    pass


class TransformError(VersalakeError, RuntimeError):
    pass


class LockTaken(VersalakeError, RuntimeError):
    """Someone else wrote the branch first."""

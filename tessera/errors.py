"""Exceptions raised by the engine; every one derives from EngineError."""


class EngineError(Exception):
    """Base of all engine errors."""


class UnexpectedError(EngineError):
    """An internal invariant did not hold."""


class ValidationError(EngineError, ValueError):
    """A query, argument or schema is not valid."""


class UserError(EngineError):
    """User code passed to the engine failed."""


class CorruptionError(EngineError):
    """Stored data or metadata can't be read back."""


class UnsupportedError(EngineError):
    """The operation is not offered, or a policy forbids it."""


class NotAuthorizedError(EngineError):
    """The caller may not do this."""


class ConflictError(EngineError):
    """Another writer committed first; retry."""

"""Errors that callers can tell apart."""


class DecompositionError(ValueError):
    """A request that can't be computed as asked."""


class NotIdentifiedError(DecompositionError):
    """The data don't identify what was asked for."""


class BackendUnavailableError(DecompositionError):
    """A device or library that this engine doesn't have."""

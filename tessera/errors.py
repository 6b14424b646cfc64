"""Errors that callers can tell apart."""


class DataError(ValueError):
    """The data can't be used as they are."""


class ParameterError(ValueError):
    """A parameter is missing or out of range."""


class GenerationError(RuntimeError):
    """A generator gave nothing that can be used."""

"""Errors with stable codes."""


class CodedError(Exception):
    def __init__(self, code: str, message: str, **details):
        super().__init__(f"{code}: {message}")
        self.code, self.message, self.details = code, message, details


class BuildError(CodedError):
    """A configuration, a source or a finished index is not as it must be."""


class QueryError(CodedError):
    """A request names a field it may not use, or none that exists."""

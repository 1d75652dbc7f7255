"""Typed errors raised by argument checks and bounded jobs."""

from __future__ import annotations


class DataError(Exception):
    """An error with a stable code and machine-readable context."""

    def __init__(self, code: str, message: str, **context: object) -> None:
        super().__init__(f"{code}: {message}")
        self.code = code
        self.message = message
        self.context = context

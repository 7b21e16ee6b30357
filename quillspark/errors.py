"""Errors that callers can tell apart."""

from __future__ import annotations


class QuillError(Exception):
    """Anything that a user can put right."""


class ConfigError(QuillError):
    pass


class QueryError(QuillError):
    """A search text without anything to search for."""


class NotFoundError(QuillError):
    """An unknown or ambiguous document or section; suggestions may help."""

    def __init__(self, message: str, suggestions: tuple | list = ()):
        super().__init__(message)
        self.suggestions = list(suggestions)


class StoreBusyError(QuillError):
    """Another process is writing the index and didn't end in time."""

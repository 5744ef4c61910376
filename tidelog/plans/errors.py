"""Diagnostics with stable codes and the place in the source that they are about."""

from __future__ import annotations


class SearchError(ValueError):
    """A search that can't be run: ``code`` is stable, ``start`` and ``end`` are the half-open UTF-8 byte range in the source."""

    def __init__(self, code: str, message: str, start: int = 0, end: int | None = None):
        super().__init__(f"{code}: {message}")
        self.code, self.message, self.start, self.end = code, message, start, start if end is None else end


class DataError(ValueError):
    """A search whose data break one of its limits; nothing of its result is published."""

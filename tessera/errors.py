"""The engine's one exception."""

from __future__ import annotations


class QueryError(ValueError):
    """A request that can't be answered. ``code`` is the number that clients know, ``msg`` the text."""

    def __init__(self, code: int, msg: str):
        super().__init__(msg)
        self.code, self.msg = code, msg


# Error numbers that requests can meet in several places.
BAD_VALUE, FAILED_TO_PARSE, TYPE_MISMATCH, NOT_VIABLE = 2, 9, 14, 28
CONFLICT, NOT_SINGLE, EMPTY_NAME, DOLLAR_NAME, IMMUTABLE = 40, 54, 56, 52, 66
BAD_REGEX, BAD_REGEX_OPTIONS = 51091, 51108


def bad(msg: str, code: int = BAD_VALUE) -> QueryError:
    return QueryError(code, msg)

"""Text search: does any alternative of a pattern occur in a column?"""

from __future__ import annotations

import functools
import operator
import re

from pyspark.sql import Column

# Only a line feed ends a line: a dot may stand for the return of an HTTP line break.
UNIX_LINES = "(?d)"

_META = re.compile(r"(?<!\\)[.^$*+?{}\[\]()]")


def _unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text)


def _alternative(column: Column, pattern: str) -> Column:
    meta = _META.search(pattern)
    if meta is None:
        return column.contains(_unescape(pattern))
    prefix = pattern[:meta.start()]
    if meta.group() in "*?{":  # the character before may be absent, so it cannot be required
        prefix = re.sub(r"\\?.$", "", prefix)
    prefix = _unescape(prefix)
    found = column.rlike(UNIX_LINES + pattern)
    return column.contains(prefix) & found if prefix else found


def any_of(column: Column, pattern: str) -> Column:
    """True where one of the ``|``-separated alternatives occurs in ``column``.

    Plain words become byte-wise ``contains``, which stays in generated code and is
    several times faster than one big regular expression. Alternatives that need the
    regular expression are guarded by the literal text they start with.
    """
    return functools.reduce(operator.or_, [_alternative(column, a) for a in pattern.split("|")])

"""LIKE patterns from plain values."""

from __future__ import annotations

from pyspark.sql import Column

#: Filter -> pattern around the value.
PATTERNS = {"contains": "%{}%", "startsWith": "{}%", "endsWith": "%{}"}


def matches(c: Column, op: str, value: str, *, insensitive: bool = False, escape: bool = False) -> Column:
    """``c`` LIKE the value's pattern. ``%`` and ``_`` in the value are wildcards unless escaped."""
    value = value.replace("\\", "\\\\")  # Spark's escape sign; a lone one is an error
    if escape:
        value = value.replace("%", "\\%").replace("_", "\\_")
    pattern = PATTERNS[op].format(value)
    return c.ilike(pattern) if insensitive else c.like(pattern)

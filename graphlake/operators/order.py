"""Order, limit, offset and keyset predicates."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlake.errors import fail
from graphlake.schema import Table
from graphlake.values import UNSET, given


def order_entries(table: Table, order: Any, lenient: bool = False) -> list[tuple[str, str]]:
    """(column, asc or desc) in order; ``order`` is a dict or a list of dicts."""
    out = []
    for entry in [] if order in (None, UNSET) else order if isinstance(order, (list, tuple)) else [order]:
        for key, direction in given(entry).items():
            if key in table.columns:
                out.append((key, "desc" if direction == "desc" else "asc"))
            elif not lenient:
                raise fail(f'Unknown column "{key}" in an order of {table.name}')
    return out


def sort_columns(entries: list[tuple[str, str]]) -> list[Column]:
    """NULLs first in ascending order and last in descending."""
    return [F.col(k).desc_nulls_last() if d == "desc" else F.col(k).asc_nulls_first() for k, d in entries]


def with_key(table: Table, entries: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The entries and the primary key (all columns without one) as tie-break, for a fixed order."""
    named = {k for k, _ in entries}
    return entries + [(k, "asc") for k in (table.primary_key or table.columns) if k not in named]


def cursor_condition(cursor: Any, entries: list[tuple[str, str]], take: Any) -> Column | None:
    """Rows strictly beyond the cursor's first column: in the direction of the first order entry if that
    orders by it, else of the sign of ``take``."""
    if not cursor:
        return None
    key, value = next(iter(given(cursor).items()), (None, None))
    if key is None:
        return None
    if entries and entries[0][0] == key:
        down = entries[0][1] == "desc"
    else:
        down = isinstance(take, int) and take < 0
    return F.col(key) < F.lit(value) if down else F.col(key) > F.lit(value)


def page(df: DataFrame, entries: list[tuple[str, str]], take: Any = None, skip: Any = None) -> DataFrame:
    """Sorted, offset and limited: one TakeOrderedAndProject where there is a limit. A negative ``take``
    limits as its absolute value does."""
    if entries:
        df = df.orderBy(*sort_columns(entries))
    if isinstance(skip, int) and skip > 0:
        df = df.offset(skip)
    if isinstance(take, int):
        df = df.limit(abs(take))
    return df

"""Reads: lazy results over DataFrames, pagination by offset and by key."""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import Row

from graphlake.errors import EngineError, ErrorCode, fail
from graphlake.operators.graph import GraphBuilder, deferred_relations
from graphlake.operators.order import cursor_condition, order_entries, page, sort_columns
from graphlake.plans.explain import explain_statements
from graphlake.schema import Table
from graphlake.values import UNSET, given


def plain(value: Any) -> Any:
    """Rows as dicts, all the way down."""
    if isinstance(value, Row):
        return {k: plain(v) for k, v in value.asDict(recursive=False).items()}
    if isinstance(value, list):
        return [plain(v) for v in value]
    return value


class Result:
    """A read that runs when its value is asked for, once. ``df`` is the plan of its data: ``data``, or else the first statement."""

    def __init__(self, statements: dict[str, DataFrame], compute: Callable[[], Any], *, data: DataFrame | None = None, relations: list[dict] | None = None, finish: Callable[[Any], Any] | None = None):
        self.statements, self._compute, self._data, self._relations, self._finish = statements, compute, data, relations or [], finish
        self._done, self._value = False, None

    @property
    def df(self) -> DataFrame:
        return next(iter(self.statements.values())) if self._data is None else self._data

    def value(self) -> Any:
        if not self._done:
            value = self._compute()
            self._value = self._finish(value) if self._finish else value
            self._done = True
        return self._value

    rows = value

    def or_throw(self, factory: Callable[[], BaseException] | BaseException | None = None) -> Any:
        """The value, or an error if there is none."""
        value = self.value()
        if value is None:
            if factory is not None:
                raise factory() if callable(factory) and not isinstance(factory, BaseException) else factory
            raise EngineError(ErrorCode.RESULT_NOT_FOUND, "No row matches")
        return value

    def explain(self, **options: Any) -> dict:
        """The plan of every statement, without running any."""
        return explain_statements(self.statements, self._relations, options)


class Reader:
    """Compiles the read requests of one table."""

    def __init__(self, table: Table, schema, scan, compiler, *, lenient: bool = False):
        self.table, self.schema, self.scan, self.compiler, self.lenient = table, schema, scan, compiler, lenient
        self.graph = GraphBuilder(schema, scan, compiler, lenient)

    def matching(self, args: dict, *, ordered: bool = True) -> tuple[DataFrame, list[tuple[str, str]]]:
        """The rows that pass ``where`` and ``cursor``, and the order asked for."""
        entries = order_entries(self.table, args.get("orderBy"), self.lenient)
        df = self.compiler.apply(self.table, self.scan(self.table.name), args.get("where"))
        beyond = cursor_condition(args.get("cursor"), entries if ordered else [], args.get("take"))
        return (df if beyond is None else df.where(beyond)), entries

    def shaped(self, df: DataFrame, args: dict, entries: list[tuple[str, str]], few: bool) -> DataFrame:
        """Projection and relations; joins lose the order, so it is set again after them."""
        joins = any(k in self.table.relations or k in self.table.ambiguous or k == "_count" for k in given(args.get("include") or args.get("select") or {}))
        if not (joins and entries):
            return self.graph.project(self.table, df, args, few=few)
        marks = [f"__o{i}" for i in range(len(entries))]
        df = self.graph.project(self.table, df.select("*", *(F.col(k).alias(m) for m, (k, _) in zip(marks, entries))), args, few=few, keep=tuple(marks))
        return df.orderBy(*sort_columns([(m, d) for m, (_, d) in zip(marks, entries)])).drop(*marks)

    def data(self, args: dict, take: Any = UNSET) -> DataFrame:
        df, entries = self.matching(args)
        take = args.get("take") if take is UNSET else take
        df = page(df, entries, take, args.get("skip"))
        return self.shaped(df, args, entries, few=isinstance(take, int) or args.get("where") not in (None, UNSET))

    def _relations(self, args: dict) -> list[dict]:
        return deferred_relations(self.schema, self.table, args)

    def find_many(self, args: dict, finish=None) -> Result:
        df = self.data(args)
        return Result({"data": df}, lambda: [plain(r) for r in df.collect()], relations=self._relations(args), finish=finish)

    def find_first(self, args: dict, finish=None) -> Result:
        take = args.get("take")
        df = self.data(args, take if isinstance(take, int) else 1)

        def first() -> dict | None:
            rows = df.take(1)
            return plain(rows[0]) if rows else None

        return Result({"data": df}, first, relations=self._relations(args), finish=finish)

    def count(self, args: dict, finish=None) -> Result:
        df, _ = self.matching(args, ordered=False)
        df = df.agg(F.count("*").alias("count"))
        return Result({"count": df}, lambda: df.first()[0], finish=finish)

    def exists(self, args: dict, finish=None) -> Result:
        df, _ = self.matching(args, ordered=False)
        df = df.select(F.lit(1).alias("exists")).limit(1)
        return Result({"exists": df}, lambda: bool(df.take(1)), finish=finish)

    def paginate(self, args: dict, finish=None) -> Result:
        """A page by offset and its metadata. The total leaves the cursor out."""
        take = args.get("take") if isinstance(args.get("take"), int) else args.get("limit") if isinstance(args.get("limit"), int) else 10
        take, skip = abs(take), max(args.get("skip") or 0, 0)
        data = self.data(args | {"take": take, "skip": skip})
        total = self.matching(args | {"cursor": None})[0].agg(F.count("*").alias("total"))

        def run() -> dict:
            rows, n = [plain(r) for r in data.collect()], total.first()[0]
            return {"data": rows, "pagination": page_meta(n, take, skip)}

        return Result({"data": data, "total": total}, run, relations=self._relations(args), finish=finish)

    # keyset pages

    def _keyset(self, args: dict) -> dict:
        cursor = args.get("cursor") or {}
        if not isinstance(cursor, dict):
            raise fail("cursor is a dict with before or after")
        before, after = cursor.get("before"), cursor.get("after")
        if before and after:
            raise fail("cursor takes before or after, not both")
        entries = order_entries(self.table, args.get("orderBy"), self.lenient)
        token = next(iter(given(before or after or {})), None)
        if not entries and token:
            entries = [(token, "asc" if before else "desc")]
        field = token or (entries[0][0] if entries else self.table.primary_key[0] if self.table.primary_key else None)
        if field is None:
            raise fail("A keyset page needs a cursor, an order or a primary key")
        limit = next((abs(args[k]) for k in ("limit", "take") if isinstance(args.get(k), int)), 10) or 10
        return {"before": before, "after": after, "entries": entries, "field": field, "limit": limit}

    def _beyond(self, cursor: dict, entries: list[tuple[str, str]], backwards: bool):
        key, value = next(iter(given(cursor).items()))
        down = next((d for k, d in entries if k == key), "asc") == "desc"
        return F.col(key) < F.lit(value) if down != backwards else F.col(key) > F.lit(value)

    def cursor_frame(self, args: dict, ahead: bool = False) -> DataFrame:
        """The rows of a keyset page in the order asked for; ``ahead``: with one beyond its limit, in the order of travel."""
        k = self._keyset(args)
        df = self.compiler.apply(self.table, self.scan(self.table.name), args.get("where"))
        entries = k["entries"]
        if k["before"] or k["after"]:
            df = df.where(self._beyond(k["before"] or k["after"], entries, bool(k["before"])))
        if k["before"]:
            entries = [(c, "asc" if d == "desc" else "desc") for c, d in entries]
        df = page(df, entries, k["limit"] + ahead, args.get("skip"))
        if k["before"] and not ahead:
            df, entries = page(df, k["entries"]), k["entries"]
        return self.shaped(df, args, entries, few=True)

    def cursor(self, args: dict, finish=None) -> Result:
        k = self._keyset(args)
        data = self.cursor_frame(args, ahead=True)
        if k["field"] not in data.columns:
            raise fail(f'The cursor column "{k["field"]}" must be selected')
        where = self.compiler.apply(self.table, self.scan(self.table.name), args.get("where"))

        def probe(edge: Any, backwards: bool) -> bool:
            return bool(where.where(self._beyond({k["field"]: edge}, k["entries"], backwards)).select(F.lit(1)).take(1))

        def run() -> dict:
            rows = [plain(r) for r in data.collect()]
            more, rows = len(rows) > k["limit"], rows[: k["limit"]]
            if k["before"]:
                rows.reverse()
            first, last = (rows[0][k["field"]], rows[-1][k["field"]]) if rows else (None, None)
            if k["before"]:
                has_previous, has_next = more, bool(rows) and probe(last, False)
            else:
                has_next, has_previous = more, bool(rows) and probe(first, True)
            meta = {"type": "cursor", "hasNext": has_next, "hasPrevious": has_previous}
            meta |= {"nextCursor": {k["field"]: last} if has_next else None, "previousCursor": {k["field"]: first} if has_previous else None}
            return {"data": rows, "pagination": meta}

        return Result({"data": data}, run, data=self.cursor_frame(args), relations=self._relations(args), finish=finish)


def page_meta(total: int, take: int, skip: int) -> dict:
    """The metadata of a page by offset."""
    pages = math.ceil(total / take) if take and total else 0
    return {"type": "offset", "page": skip // take + 1 if take else 1, "perPage": take, "total": total, "pageCount": pages, "hasNext": skip + take < total, "hasPrevious": skip > 0 and total > 0}

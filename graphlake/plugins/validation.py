"""Validation of payloads, query arguments and results against the declared tables."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date, datetime
from decimal import Decimal, InvalidOperation
from typing import Any

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from graphlake.errors import EngineError, ErrorCode
from graphlake.hooks import FAMILY, Operation, Plugin
from graphlake.schema import Column, Table
from graphlake.values import UNSET, given

#: Integer ranges by Spark type (fixed values).
RANGES = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}
UUID = re.compile(r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")


def _error(path: str, message: str) -> EngineError:
    return EngineError(ErrorCode.OPERATION_ERROR, f"Validation failed at {path}: {message}", status=422, details={"path": path})


def check_value(path: str, column: Column, value: Any, coerce: bool = False) -> Any:
    """The value, converted if asked, or an error that names its path."""
    kind = column.dtype
    if value is None:
        if not column.nullable:
            raise _error(path, "null is not allowed")
        return None
    if isinstance(value, SparkColumn):
        return value
    if isinstance(kind, tuple(RANGES)):
        if coerce and isinstance(value, str) and re.fullmatch(r"\s*[+-]?\d+\s*", value):
            value = int(value)
        if isinstance(value, bool) or not isinstance(value, int):
            raise _error(path, "a whole number is expected")
        bits = RANGES[type(kind)]
        if not -(1 << bits - 1) <= value < 1 << bits - 1:
            raise _error(path, f"the number doesn't fit into {bits} bits")
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        if coerce and isinstance(value, str):
            try:
                value = float(value)
            except ValueError:
                raise _error(path, "a number is expected") from None
        if isinstance(value, bool) or not isinstance(value, (int, float)) or isinstance(value, float) and not math.isfinite(value):
            raise _error(path, "a number is expected")
    elif isinstance(kind, T.DecimalType):
        if not isinstance(value, (str, Decimal)) and not (coerce and isinstance(value, (int, float))):
            raise _error(path, "a decimal, as a string, is expected")
        try:
            value = Decimal(str(value))
        except InvalidOperation:
            raise _error(path, "a decimal is expected") from None
    elif isinstance(kind, T.BooleanType):
        if coerce and value in (0, 1, "true", "false"):
            value = value in (1, "true")
        if not isinstance(value, bool):
            raise _error(path, "true or false is expected")
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        if coerce and isinstance(value, str):
            try:
                value = datetime.fromisoformat(value)
            except ValueError:
                raise _error(path, "a time is expected") from None
        if not isinstance(value, (datetime, date)):
            raise _error(path, "a time is expected")
    elif isinstance(kind, T.BinaryType):
        if not isinstance(value, (bytes, bytearray)):
            raise _error(path, "bytes are expected")
    elif isinstance(kind, T.StringType):
        if coerce and not isinstance(value, str):
            value = str(value)
        if not isinstance(value, str):
            raise _error(path, "a string is expected")
        if column.enum and value not in column.enum:
            raise _error(path, "one of " + ", ".join(column.enum) + " is expected")
    return value


@dataclass
class Shape:
    """What create, update and select accept. ``fields``: per column False (left out), a function
    (value -> value), or a Column that replaces the declared one."""

    table: Table
    unknown: str = "strict"  # strip, strict, passthrough
    coerce: bool = False
    omit: tuple[str, ...] = ()
    extend: dict[str, Callable[[Any], Any]] = field(default_factory=dict)
    partial: bool = False
    fields: dict[str, Any] = field(default_factory=dict)

    def columns(self) -> dict[str, Column]:
        return {k: c for k, c in self.table.columns.items() if k not in self.omit and self.fields.get(k) is not False}

    def _parse(self, data: Any, path: str, required: Callable[[str, Column], bool], keep_generated: bool) -> dict:
        if not isinstance(data, dict):
            raise _error(path, "an object is expected")
        columns = {k: c for k, c in self.columns().items() if keep_generated or not c.generated}
        out = {}
        for k, v in given(data).items():
            at = f"{path}.{k}"
            rule = self.fields.get(k)
            if k in self.extend:
                out[k] = self.extend[k](v)
            elif k in columns:
                if callable(rule) and not isinstance(rule, Column):
                    try:
                        out[k] = rule(v)
                    except (ValueError, TypeError) as e:
                        raise _error(at, str(e)) from e
                else:
                    out[k] = check_value(at, rule if isinstance(rule, Column) else columns[k], v, self.coerce)
            elif k in self.table.relations or k in self.table.ambiguous:
                out[k] = v
            elif self.unknown == "strict":
                raise _error(at, "unknown key")
            elif self.unknown == "passthrough":
                out[k] = v
        for k, c in columns.items():
            if k not in out and not self.partial and required(k, c):
                raise _error(f"{path}.{k}", "a value is required")
        return out

    def create(self, data: Any, path: str = "data", relations: tuple[str, ...] = ()) -> dict:
        linked = {f for r in self.table.relations.values() if isinstance(data, dict) and r.name in data for f in r.fields}
        return self._parse(data, path, lambda k, c: not (c.nullable or c.has_default or k in linked), False)

    def update(self, data: Any, path: str = "data") -> dict:
        return self._parse(data, path, lambda k, c: False, False)

    def select(self, row: Any, path: str = "row") -> dict:
        return self._parse(row, path, lambda k, c: not c.nullable, True)

    def where(self, where: Any, path: str = "where") -> Any:
        """Known columns, relations and connectives with filters of the right form."""
        from graphlake.operators.where import FILTER_KEYS

        if where in (None, UNSET) or isinstance(where, (str, SparkColumn)):
            return where
        if not isinstance(where, dict):
            raise _error(path, "an object is expected")
        for k, v in given(where).items():
            at = f"{path}.{k}"
            if k in ("AND", "OR", "NOT"):
                for w in v if isinstance(v, (list, tuple)) else [v]:
                    self.where(w, at)
            elif k in self.table.columns:
                if isinstance(v, dict) and not (set(v) <= FILTER_KEYS | {"json"}):
                    raise _error(at, "unknown filter " + ", ".join(sorted(set(v) - FILTER_KEYS)))
            elif k not in self.table.relations:
                raise _error(at, "unknown column")
        return where

    def order_by(self, order: Any, path: str = "orderBy") -> Any:
        for entry in [] if order in (None, UNSET) else order if isinstance(order, (list, tuple)) else [order]:
            for k, d in entry.items():
                if k not in self.table.columns or d not in ("asc", "desc", UNSET):
                    raise _error(f"{path}.{k}", "a column with asc or desc is expected")
        return order

    def pagination(self, args: dict) -> dict:
        for k in ("take", "skip", "limit"):
            v = args.get(k)
            if v not in (None, UNSET) and (isinstance(v, bool) or not isinstance(v, int)):
                raise _error(k, "a whole number is expected")
        if isinstance(args.get("skip"), int) and args["skip"] < 0:
            raise _error("skip", "may not be negative")
        return args

    def query(self, args: dict) -> dict:
        self.where(args.get("where"))
        self.order_by(args.get("orderBy"))
        return self.pagination(args)

    def upsert(self, args: dict) -> dict:
        return {**args, "create": self.create(args.get("create"), "create"), "update": self.update(args.get("update") or {}, "update")}


def validation(*, payload: bool = True, result: bool = True, query: bool = False, models: dict[str, dict] | None = None, **shape: Any) -> Plugin:
    """Payloads and results are checked by default, query arguments if asked; ``validate`` of a call (a dict of
    payload, result, query, or False for none) wins. ``models``: Shape options by model, over those given for
    all. Results that are DataFrames are checked by their schema, not row by row."""

    def shape_of(op: Operation) -> Shape:
        return Shape(op.client.schema.table(op.model), **{**shape, **((models or {}).get(op.model) or {})})

    def wants(op: Operation) -> dict:
        given_args = op.state.get("__validate", op.args.get("validate"))
        base = {"payload": payload, "result": result, "query": query}
        if given_args is False:
            return dict.fromkeys(base, False)
        return base | (given_args if isinstance(given_args, dict) else {})

    def transform(op: Operation) -> dict | None:
        on, args = wants(op), dict(op.args)
        op.state["__validate"] = args.pop("validate", None)
        s = shape_of(op)
        if on["query"]:
            s.query(args)
        if on["payload"] and FAMILY[op.kind] in ("Create", "Update"):
            data = args.get("data")
            if isinstance(data, DataFrame):
                unknown = [c for c in data.columns if c not in s.columns()]
                if unknown and s.unknown == "strict":
                    raise _error(f"data.{unknown[0]}", "unknown key")
            elif op.kind == "create":
                args["data"] = s.create(data)
            elif op.kind in ("createMany", "upsertMany"):
                args["data"] = [s.create(r, f"data[{i}]") for i, r in enumerate(data or [])]
            elif op.kind in ("update", "updateMany"):
                args["data"] = s.update(data or {})
            elif op.kind == "updateEach" and not callable(args.get("update")):
                args["data"] = [s.update(r, f"data[{i}]") for i, r in enumerate(data or [])]
            elif op.kind == "upsert":
                args = s.upsert(args)
            if op.kind == "updateEach" and args.get("onEmpty") not in (None, UNSET, "return", "throw", "ignore"):
                raise _error("onEmpty", "return or throw is expected")
        return args

    def after(op: Operation) -> None:
        if op.state.get("__validate") is False or not wants(op)["result"]:
            return
        value = op.result
        rows = value.get("data") if isinstance(value, dict) and "data" in value and ("count" in value or "pagination" in value) else value
        s = shape_of(op)
        s.partial, s.unknown = True, "passthrough"
        for i, row in enumerate(rows if isinstance(rows, list) else [rows] if isinstance(rows, dict) and "count" not in rows else []):
            s.select(row, f"result[{i}]")

    hooks = {f"after{f}": after for f in ("Create", "Update", "Delete", "Query")}
    return Plugin("validation", operation_args=dict.fromkeys(FAMILY, ("validate",)), transform=transform, hooks=hooks)

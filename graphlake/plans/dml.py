"""INSERT, UPDATE and DELETE statements as new versions of tables: each becomes one SELECT that Spark plans."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import functions as F

from graphlake.errors import EngineError, ErrorCode

_COMMENT = re.compile(r"^\s*/\*.*?\*/", re.S)
_INSERT = re.compile(r"^\s*insert\s+into\s+`?(\w+)`?\s*(?:\(([^)]*)\))?\s*((?:select|values|with)\b.*)$", re.I | re.S)
_UPDATE = re.compile(r"^\s*update\s+`?(\w+)`?\s+set\s+(.*)$", re.I | re.S)
_DELETE = re.compile(r"^\s*delete\s+from\s+`?(\w+)`?\s*(?:where\s+(.*))?$", re.I | re.S)


def _outside(text: str) -> list[bool]:
    """By character: outside quotes and parentheses."""
    out, depth, quote = [], 0, ""
    for ch in text:
        if quote:
            quote = "" if ch == quote else quote
            out.append(False)
            continue
        if ch in "'\"`":
            quote = ch
        depth += (ch == "(") - (ch == ")")
        out.append(depth == 0 and not quote and ch != ")")
    return out


def _split(text: str, word: str) -> list[str]:
    """The parts between occurrences of a word or sign that stand outside quotes and parentheses."""
    free = _outside(text)
    parts, at = [], 0
    for m in re.finditer(rf"\b{word}\b" if word.isalpha() else re.escape(word), text, re.I):
        if free[m.start()]:
            parts.append(text[at : m.start()])
            at = m.end()
    return [*parts, text[at:]]


def run_dml(spark, schema, snapshot, writer_of, sql: str, params: Any) -> dict:
    text = _COMMENT.sub("", sql).strip().rstrip(";")
    if m := _INSERT.match(text):
        table = schema.table(m[1])
        cols = [c.strip(" `\n") for c in m[2].split(",")] if m[2] else list(table.columns)
        query = m[3] if not re.match(r"values\b", m[3], re.I) else f"SELECT * FROM ({m[3]})"
        rows = spark.sql(query, args=params or None)
        rows = rows.toDF(*[table.key_of(c) or c for c in cols])
        return {"rowsAffected": writer_of(table.name).insert(rows).count()}
    if m := _UPDATE.match(text):
        table = schema.table(m[1])
        body = _split(m[2], "where")
        sets = [_split(s, "=") for s in _split(body[0], ",")]
        if any(len(s) < 2 for s in sets):
            raise EngineError(ErrorCode.RAW_INVALID_QUERY, "UPDATE needs column = value")
        keys = [table.key_of(s[0].strip(" `\n")) or s[0].strip() for s in sets]
        for k in keys:
            if k not in table.columns:
                raise EngineError(ErrorCode.RAW_INVALID_QUERY, f"Unknown column {k}")
        values = ", ".join(f"{'='.join(s[1:])} AS __v{i}" for i, s in enumerate(sets))
        hit = body[1] if len(body) > 1 else "true"
        df = spark.sql(f"SELECT *, {values}, coalesce({hit}, false) AS __hit FROM {table.name}", args=params or None)
        new = df.select(*((F.when(F.col("__hit"), F.col(f"__v{keys.index(k)}").cast(c.dtype)).otherwise(F.col(k)).alias(k) if k in keys else F.col(k)) for k, c in table.columns.items()), "__hit")
        w = writer_of(table.name)
        w.check_not_null(new.where("__hit").select(*keys))
        touched = [key for key in table.keys if set(key) & set(keys)]
        w.check_unique(new.drop("__hit"), new.drop("__hit").where("false"), touched)
        count = new.where("__hit").count()
        snapshot.put(table, new.drop("__hit"))
        return {"rowsAffected": count}
    if m := _DELETE.match(text):
        table = schema.table(m[1])
        df = spark.sql(f"SELECT *, coalesce({m[2] or 'true'}, false) AS __hit FROM {table.name}", args=params or None)
        count = df.where("__hit").count()
        snapshot.put(table, df.where("not __hit").drop("__hit"))
        return {"rowsAffected": count}
    raise EngineError(ErrorCode.RAW_INVALID_QUERY, "Only INSERT INTO, UPDATE and DELETE FROM change tables")

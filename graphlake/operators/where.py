"""Filters to boolean Columns. Scalar terms are native expressions that reach the scan; relation terms are
correlated EXISTS, which Catalyst turns into semi, anti and existence joins wherever they stand."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlake.errors import fail
from graphlake.functions.json_path import JsonPath, is_number
from graphlake.functions.patterns import PATTERNS, matches
from graphlake.schema import Relation, Table
from graphlake.values import UNSET, given

#: The keys that make a dict a filter (fixed values).
FILTER_KEYS = {"equals", "in", "notIn", "lt", "lte", "gt", "gte", "contains", "startsWith", "endsWith", "mode", "not"}
_COMPARE = {"lt": lambda c, v: c < v, "lte": lambda c, v: c <= v, "gt": lambda c, v: c > v, "gte": lambda c, v: c >= v}


def both(a: Column | None, b: Column | None) -> Column | None:
    return b if a is None else a if b is None else a & b


def all_of(terms) -> Column | None:
    return reduce(both, terms, None)


def equal(c: Column, v: Any) -> Column:
    return c.isNull() if v is None else c == F.lit(v)


class WhereCompiler:
    """Compiles filters of one client. ``scan`` gives a table's rows; aliases are t1, t2, ..."""

    def __init__(self, schema, scan, *, lenient: bool = False, escape_like: bool = False):
        self.schema, self.scan, self.lenient, self.escape_like = schema, scan, lenient, escape_like
        self.count = 0

    def alias(self) -> str:
        self.count += 1
        return f"t{self.count}"

    def apply(self, table: Table, df: DataFrame, where: Any) -> DataFrame:
        """The rows of ``df`` that pass; the columns are as before."""
        if where is None or where is UNSET:
            return df
        a = self.alias()
        aliased = df.alias(a)
        cond = self.compile(table, where, a)
        return df if cond is None else aliased.where(cond).select(*(F.col(f"{a}.{c}").alias(c) for c in df.columns))

    def compile(self, table: Table, where: Any, alias: str, negated: bool = False) -> Column | None:
        if where is None or where is UNSET:
            return None
        if isinstance(where, Column):
            return where
        if isinstance(where, str):
            return F.expr(where)
        return all_of(self._term(table, k, v, alias, negated) for k, v in given(where).items())

    def _term(self, table: Table, key: str, value: Any, alias: str, negated: bool) -> Column | None:
        if key == "AND" and isinstance(value, (list, tuple)):
            return all_of(self.compile(table, w, alias, negated) for w in value)
        if key == "OR" and isinstance(value, (list, tuple)):
            terms = [t for w in value if (t := self.compile(table, w, alias, negated)) is not None]
            return reduce(lambda a, b: a | b, terms) if terms else None
        if key == "NOT" and isinstance(value, (list, tuple, dict, Column, str)):
            terms = [self.compile(table, w, alias, True) for w in (value if isinstance(value, (list, tuple)) else [value])]
            return all_of(~t for t in terms if t is not None)
        if key in table.relations or key in table.ambiguous:
            return self._relation(table, self.schema.relation(table, key), value, alias, negated)
        if key in table.columns:
            c = F.col(f"{alias}.{key}")
            if isinstance(value, dict) and "json" in value:
                return self._json(c, value["json"])
            return self.scalar(c, value)
        if self.lenient:
            return None
        raise fail(f'Unknown column "{key}" in a filter on {table.name}', table=table.name, key=key)

    def scalar(self, c: Column, value: Any) -> Column | None:
        if value is None:
            return c.isNull()
        if not isinstance(value, dict):
            return c == F.lit(value)
        if not value.keys() & FILTER_KEYS:
            raise fail("A filter is a value or has one of the keys " + ", ".join(sorted(FILTER_KEYS)))
        insensitive = value.get("mode") == "insensitive"
        terms = []
        for op, v in given(value).items():
            if op == "equals":
                terms.append(equal(c, v))
            elif op == "in" and isinstance(v, (list, tuple, set)):
                terms.append(c.isin(list(v)) if v else F.lit(False))
            elif op == "notIn" and isinstance(v, (list, tuple, set)):
                terms.append(~c.isin(list(v)) if v else F.lit(True))
            elif op in _COMPARE:
                terms.append(_COMPARE[op](c, F.lit(v)))
            elif op in PATTERNS:
                terms.append(matches(c, op, v, insensitive=insensitive, escape=self.escape_like))
            elif op == "not":
                inner = self.scalar(c, v)
                terms.append(None if inner is None else ~inner)
        return all_of(terms)

    # JSON paths

    def _json(self, c: Column, paths: dict) -> Column | None:
        return all_of(self._json_filter(JsonPath(c, path), v) for path, v in given(paths).items())

    def _json_filter(self, at: JsonPath, value: Any) -> Column | None:
        if not isinstance(value, dict):
            return at.equals(value)
        terms: list[Column | None] = []
        for op, x in given(value).items():
            if op == "equals":
                terms.append(at.equals(x))
            elif op in _COMPARE:
                terms.append(at.number(x, _COMPARE[op]) if is_number(x) else None)  # other operands make no condition
            elif op in PATTERNS:
                ok, got = at.typed("")
                terms.append(ok & matches(got, op, x, escape=self.escape_like))
            elif op == "in":
                terms.append(reduce(lambda a, b: a | b, [at.equals(y) for y in x], F.lit(False)))
            elif op == "notIn":
                terms.append(all_of(~at.equals(y) for y in x) if x else F.lit(True))
            elif op == "not":
                inner = self._json_filter(at, x)
                terms.append(None if inner is None else ~inner)
            elif op != "mode":
                raise fail(f'Unknown JSON filter "{op}"')
        return all_of(terms)

    # relations

    def exists(self, rel: Relation, alias: str, where: Any, *, negate_inner: bool = False) -> Column:
        """EXISTS(target linked to the outer row and where), through the junction if there is one."""
        target = self.schema.table(rel.target)
        t = self.alias()
        rows = self.scan(rel.target).alias(t)
        cond = self.compile(target, where, t, negate_inner)
        if negate_inner:
            cond = ~cond if cond is not None else None
        if rel.through:
            j = self.alias()
            inside = all_of(F.col(f"{j}.{a}") == F.col(f"{t}.{b}") for a, b in zip(rel.through_references, rel.references))
            rows = self.scan(rel.through).alias(j).join(rows, inside)
            link = all_of(F.col(f"{j}.{b}") == F.col(f"{alias}.{a}").outer() for a, b in zip(rel.fields, rel.through_fields))
        else:
            link = all_of(F.col(f"{t}.{b}") == F.col(f"{alias}.{a}").outer() for a, b in zip(rel.fields, rel.references))
        return rows.where(both(link, cond)).select(F.lit(1)).exists()

    def _any(self, rel: Relation, where: Any, null_reference: bool = False) -> Column:
        """EXISTS(target and where), whatever it is linked to."""
        target, t = self.schema.table(rel.target), self.alias()
        cond = self.compile(target, where, t)
        if null_reference:
            cond = both(F.col(f"{t}.{rel.references[0]}").isNull(), cond)
        rows = self.scan(rel.target).alias(t)
        return (rows if cond is None else rows.where(cond)).select(F.lit(1)).exists()

    def _relation(self, table: Table, rel: Relation, value: Any, alias: str, negated: bool) -> Column | None:
        if not isinstance(value, dict):
            raise fail(f'A filter on relation "{rel.name}" is a dict of quantifiers')
        terms: list[Column | None] = []
        for op, w in given(value).items():
            if op == "some":
                terms.append(self.exists(rel, alias, w))
            elif op == "none":
                terms.append(~self.exists(rel, alias, w))
            elif op == "every":
                terms.append(~self.exists(rel, alias, w, negate_inner=True))
            elif op == "is":
                terms.append(~self.exists(rel, alias, None) if w is None else self._is(table, rel, alias, w, negated))
            elif op == "isNot":
                terms.append(self.exists(rel, alias, None) if w is None else self._is_not(rel, alias, w, negated))
            else:
                raise fail(f'Unknown quantifier "{op}" on relation "{rel.name}"')
        return all_of(terms)

    def _is(self, table: Table, rel: Relation, alias: str, w: Any, negated: bool) -> Column:
        found = self.exists(rel, alias, w)
        if not negated or len(rel.fields) != 1 or not table.columns[rel.fields[0]].nullable or rel.fields == table.primary_key:
            return found
        # below a NOT it matters that IN gives NULL for a null key over a list that isn't empty
        fk = F.col(f"{alias}.{rel.fields[0]}")
        return F.when(fk.isNull() & self._any(rel, w), F.lit(None).cast("boolean")).otherwise(found)

    def _is_not(self, rel: Relation, alias: str, w: Any, negated: bool) -> Column:
        found = ~self.exists(rel, alias, w)
        if len(rel.fields) != 1:
            return found
        # NOT IN: a null key passes only an empty list, and a null in the list lets nothing else pass
        target = self.schema.table(rel.target)
        fk = F.col(f"{alias}.{rel.fields[0]}")
        out = found & (fk.isNotNull() | ~self._any(rel, w))
        ref = target.columns[rel.references[0]]
        return out & ~self._any(rel, w, null_reference=True) if ref.nullable and rel.references != target.primary_key else out

"""Declared tables, columns and relations; many-to-many relations are inferred from junction tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphlake.errors import EngineError, ErrorCode, fail


@dataclass(frozen=True)
class Column:
    """``type``: a Spark type or DDL string; ``source``: the name in storage, if it differs from the key."""

    type: str | T.DataType
    source: str | None = None
    nullable: bool = True
    default: Any = None
    default_factory: Callable[[], Any] | None = None
    generated: bool = False
    json: bool = False
    enum: tuple[str, ...] | None = None

    @property
    def has_default(self) -> bool:
        return self.default is not None or self.default_factory is not None or self.generated

    @property
    def dtype(self) -> T.DataType:
        return T._parse_datatype_string(self.type) if isinstance(self.type, str) else self.type

    def make_default(self) -> Any:
        return self.default_factory() if self.default_factory else self.default


@dataclass(frozen=True)
class Relation:
    """``one`` or ``many`` rows of ``target`` with target.references = source.fields; ``through``: the junction's
    name with the relations of it that lead to either side."""

    name: str
    target: str
    kind: str
    fields: tuple[str, ...]
    references: tuple[str, ...]
    owning: bool = False
    through: str | None = None
    through_fields: tuple[str, ...] = ()  # of the junction, to the source's fields
    through_references: tuple[str, ...] = ()  # of the junction, to the target's references


@dataclass
class Table:
    columns: dict[str, Column]
    primary_key: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    name: str = ""
    source: str | None = None
    relations: dict[str, Relation] = field(default_factory=dict)
    ambiguous: dict[str, list[str]] = field(default_factory=dict)

    def scan(self, df: DataFrame) -> DataFrame:
        """The declared columns under their keys: one projection, which prunes the scan."""
        return df.select(*(F.col(f"`{c.source or k}`").alias(k) for k, c in self.columns.items()))

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(k, c.dtype, True) for k, c in self.columns.items()])

    @property
    def keys(self) -> list[tuple[str, ...]]:
        return [k for k in (self.primary_key, *self.unique) if k]

    def key_of(self, name: str) -> str | None:
        """The key of a column given by key or by storage name."""
        if name in self.columns:
            return name
        return next((k for k, c in self.columns.items() if c.source == name), None)


def one(target: str, fields: str | tuple[str, ...], references: str | tuple[str, ...], *, owning: bool = True) -> dict:
    return {"target": target, "kind": "one", "fields": _tuple(fields), "references": _tuple(references), "owning": owning}


def many(target: str, fields: str | tuple[str, ...], references: str | tuple[str, ...]) -> dict:
    return {"target": target, "kind": "many", "fields": _tuple(fields), "references": _tuple(references), "owning": False}


def _tuple(x: str | tuple[str, ...]) -> tuple[str, ...]:
    return (x,) if isinstance(x, str) else tuple(x)


class Schema:
    """tables by key, ``relations`` by table and name as one() and many() give them.

    A table with exactly two owning one-relations to two different tables, whose other columns may be left
    out, is a junction: both ends get a many-relation named after the other end's table, unless they declare
    a relation of that name. Two junctions of one pair make the name ambiguous. ``many_to_many``: explicit
    junctions, as {"through": table, "left": {"relation": name, "name": alias}, "right": {...}}, which settle
    ambiguous names or add others; an alias is the end's own name for the relation.
    """

    def __init__(self, tables: dict[str, Table], relations: dict[str, dict[str, dict]] | None = None, many_to_many: list[dict] | None = None, *, infer_many_to_many: bool = True):
        self.tables = tables
        for name, t in tables.items():
            t.name = name
            t.relations, t.ambiguous = {}, {}
        for owner, named in (relations or {}).items():
            for rel, spec in named.items():
                self.table(spec["target"])
                for side, cols in ((owner, spec["fields"]), (spec["target"], spec["references"])):
                    for c in cols:
                        if c not in self.table(side).columns:
                            raise fail(f"Relation {owner}.{rel} names an unknown column {side}.{c}")
                tables[owner].relations[rel] = Relation(rel, **spec)
        for t in tables.values() if infer_many_to_many else ():
            ends = self._junction(t)
            if ends:
                self._expose(t, *ends)
        for spec in many_to_many or []:
            self._add_explicit(spec)

    def table(self, name: str) -> Table:
        if name in self.tables:
            return self.tables[name]
        for t in self.tables.values():
            if t.source == name:
                return t
        raise EngineError(ErrorCode.TABLE_RUNTIME_NOT_FOUND, f'No table "{name}"', details={"table": name})

    def _add_explicit(self, spec: dict) -> None:
        through = self.table(spec["through"])
        ends = [through.relations.get(spec[side]["relation"]) for side in ("left", "right")]
        if any(r is None or r.kind != "one" or not r.owning for r in ends) or not self._junction(through, ends):
            raise fail(f'many_to_many through "{through.name}": it must have two owning one-relations to two tables and no other required column')
        self._expose(through, *ends, spec["left"].get("name"), spec["right"].get("name"))

    @staticmethod
    def _junction(t: Table, ends: list[Relation] | None = None) -> list[Relation] | None:
        """The two relations that make a table a junction."""
        if ends is None:
            ends = [r for r in t.relations.values() if r.kind == "one" and r.owning]
        linked = {c for r in ends for c in r.fields}
        if len(ends) != 2 or ends[0].target == ends[1].target or any(not (c.nullable or c.has_default) for k, c in t.columns.items() if k not in linked):
            return None
        return ends

    def _expose(self, through: Table, left: Relation, right: Relation, left_name: str | None = None, right_name: str | None = None) -> None:
        """Give either end a relation to the other, under its own name for it or the other's table key."""
        for near, far, name in ((left, right, left_name), (right, left, right_name)):
            owner, name = self.tables[near.target], name or far.target
            held = owner.relations.get(name)
            if held and not held.through:
                continue
            if held and held.through != through.name:
                owner.ambiguous[name] = [*owner.ambiguous.get(name, [held.through]), through.name]
                del owner.relations[name]
                continue
            if name in owner.ambiguous and left_name is None and right_name is None and through.name not in owner.ambiguous[name] and not held:
                owner.ambiguous[name].append(through.name)
                continue
            owner.ambiguous.pop(name, None)
            owner.relations[name] = Relation(name, far.target, "many", near.references, far.references, through=through.name, through_fields=near.fields, through_references=far.fields)

    def relation(self, table: Table, name: str) -> Relation:
        if name in table.ambiguous:
            raise fail(f'Relation "{name}" of {table.name} is ambiguous: it goes through {", ".join(table.ambiguous[name])}')
        if name not in table.relations:
            raise fail(f'No relation "{name}" in {table.name}')
        return table.relations[name]

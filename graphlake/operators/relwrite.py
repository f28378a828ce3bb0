"""connect, disconnect and set inside the data of create, update and upsert."""

from __future__ import annotations

from datetime import date
from decimal import Decimal
from typing import Any

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphlake.errors import fail
from graphlake.operators.read import plain
from graphlake.operators.where import all_of
from graphlake.schema import Relation, Table
from graphlake.values import UNSET, given

COMMANDS = {"connect", "disconnect", "set"}


def split_data(schema, table: Table, data: dict) -> tuple[dict, dict[str, dict]]:
    """(column values, relation commands)."""
    values, commands = {}, {}
    for k, v in given(data).items():
        if k in table.columns:
            values[k] = v
        elif k in table.relations or k in table.ambiguous:
            schema.relation(table, k)
            commands[k] = v
        else:
            values[k] = v  # the writer names unknown columns
    return values, commands


def check_commands(commands: dict[str, dict], creating: bool) -> None:
    for name, c in commands.items():
        if not isinstance(c, dict) or not given(c):
            raise fail(f'Relation "{name}" takes connect, disconnect or set')
        c = given(c)
        if set(c) - COMMANDS:
            raise fail(f'Relation "{name}": unknown commands {", ".join(sorted(set(c) - COMMANDS))}')
        if "set" in c and len(c) > 1:
            raise fail(f'Relation "{name}": set can\'t be combined with others')
        if creating and set(c) != {"connect"}:
            raise fail(f'Relation "{name}": create allows connect only')


def _list(x: Any) -> list:
    return list(x) if isinstance(x, (list, tuple)) else [x]


class RelationWriter:
    """``writer_of`` and ``reader_of`` give the operators of another table in the same snapshot."""

    def __init__(self, schema, snapshot, writer_of, reader_of):
        self.schema, self.snapshot, self.writer_of, self.reader_of = schema, snapshot, writer_of, reader_of

    def resolve(self, target: str, selector: Any) -> dict:
        """The one row that a selector names."""
        if not isinstance(selector, dict) or not given(selector):
            raise fail(f"A selector of {target} names at least one column")
        rows = self.reader_of(target).find_many({"where": selector, "take": 2}).value()
        if len(rows) != 1:
            raise fail(f"A selector of {target} matches {'no row' if not rows else 'several rows'}", table=target)
        return rows[0]

    def _resolve_all(self, target: str, selectors: Any) -> list[dict]:
        rows, seen = [], set()
        key = self.schema.table(target).primary_key
        for row in self._each(target, _list(selectors)):
            ident = tuple(row[k] for k in key) if key else tuple(map(repr, row.values()))
            if ident not in seen:
                seen.add(ident)
                rows.append(row)
        return rows

    def _each(self, target: str, selectors: list) -> list[dict]:
        """``resolve`` for each selector. Those of plain values are found together, by one join for all that name the
        same columns."""
        table = self.schema.table(target)
        found: dict[int, dict] = {}
        alike: dict[tuple, list[int]] = {}
        for i, s in enumerate(selectors):
            own = given(s) if isinstance(s, dict) else {}
            if own and set(own) <= set(table.columns) and all(isinstance(v, (str, int, float, date, Decimal)) for v in own.values()):
                alike.setdefault(tuple(sorted(own)), []).append(i)
        for cols, at in alike.items():
            if len(at) < 2:
                continue
            typed = T.StructType([T.StructField("__i", T.LongType()), *(T.StructField(f"__s_{c}", table.schema[c].dataType) for c in cols)])
            asked = self.snapshot.store.spark.createDataFrame([(i, *(selectors[i][c] for c in cols)) for i in at], typed)
            rows = self.snapshot.scan(target).join(F.broadcast(asked), all_of(F.col(c) == F.col(f"__s_{c}") for c in cols))
            rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy("__i").orderBy(*table.columns))).where("__n <= 2")
            met: dict[int, list[dict]] = {}
            for r in rows.select("__i", *table.columns).collect():
                row = plain(r)
                met.setdefault(row.pop("__i"), []).append(row)
            for i in at:
                if len(met.get(i, [])) != 1:
                    raise fail(f"A selector of {target} matches {'several rows' if i in met else 'no row'}", table=target)
                found[i] = met[i][0]
        return [found[i] if i in found else self.resolve(target, s) for i, s in enumerate(selectors)]

    def own_keys(self, table: Table, commands: dict[str, dict]) -> dict[str, Any]:
        """Values of the foreign keys that the row itself holds."""
        out: dict[str, Any] = {}
        for name, c in commands.items():
            rel = self.schema.relation(table, name)
            if rel.kind != "one" or not rel.owning:
                continue
            c = given(c)
            chosen = c.get("connect", c.get("set"))
            if isinstance(chosen, (list, tuple)):
                if len(chosen) != 1:
                    raise fail(f'Relation "{name}" takes one row')
                chosen = chosen[0]
            if chosen is not None:
                row = self.resolve(rel.target, chosen)
                out |= {f: row[r] for f, r in zip(rel.fields, rel.references)}
            elif "disconnect" in c and c["disconnect"] in (False, UNSET):
                continue
            else:
                for f in rel.fields:
                    if not table.columns[f].nullable:
                        raise fail(f'Relation "{name}" can\'t be disconnected: {table.name}.{f} is not nullable')
                    out[f] = None
        return out

    def apply(self, table: Table, row: dict, commands: dict[str, dict]) -> None:
        """The commands on relations whose keys are elsewhere, in the order given."""
        for name, c in commands.items():
            rel = self.schema.relation(table, name)
            if rel.kind == "one" and rel.owning:
                continue
            if rel.through:
                self._through(rel, row, given(c))
            else:
                self._children(rel, row, given(c))

    def _link(self, rel: Relation, row: dict) -> dict:
        return {r: row[f] for f, r in zip(rel.fields, rel.references)}

    def _is(self, table: Table, rows: list[dict]) -> dict:
        key = table.primary_key or tuple(table.columns)
        return {"OR": [{k: r[k] for k in key} for r in rows]}

    def _children(self, rel: Relation, row: dict, c: dict) -> None:
        target = self.schema.table(rel.target)
        link, write = self._link(rel, row), self.writer_of(rel.target)
        nothing = {r: None for r in rel.references}

        def release(where: dict) -> None:
            if any(not target.columns[r].nullable for r in rel.references):
                if self.reader_of(rel.target).exists({"where": where}).value():
                    raise fail(f'Relation "{rel.name}" can\'t be disconnected: its key is not nullable')
                return
            write.assign(where, nothing)

        if "set" in c:
            rows = self._resolve_all(rel.target, c["set"]) if c["set"] not in (None, []) else []
            if rel.kind == "one" and len(rows) > 1:
                raise fail(f'Relation "{rel.name}" takes one row')
            release(link | ({"NOT": self._is(target, rows)} if rows else {}))
            if rows:
                write.assign(self._is(target, rows), link)
            return
        if "disconnect" in c and c["disconnect"] not in (False, UNSET):
            if c["disconnect"] is True:
                release(link)
            else:
                release({"AND": [link, self._is(target, self._resolve_all(rel.target, c["disconnect"]))]})
        if "connect" in c:
            rows = self._resolve_all(rel.target, c["connect"])
            if rel.kind == "one":
                if len(rows) > 1:
                    raise fail(f'Relation "{rel.name}" takes one row')
                release(link | {"NOT": self._is(target, rows)})
            write.assign(self._is(target, rows), link)

    def _through(self, rel: Relation, row: dict, c: dict) -> None:
        junction, write = self.schema.table(rel.through), self.writer_of(rel.through)
        own = {j: row[f] for f, j in zip(rel.fields, rel.through_fields)}

        def pair(t: dict) -> dict:
            return own | {j: t[r] for r, j in zip(rel.references, rel.through_references)}

        if "set" in c:
            write.remove(own)
            c = {"connect": c["set"]} if c["set"] not in (None, []) else {}
        if "disconnect" in c and c["disconnect"] not in (False, UNSET):
            if c["disconnect"] is True:
                write.remove(own)
            else:
                write.remove({"OR": [pair(t) for t in self._resolve_all(rel.target, c["disconnect"])]})
        if "connect" in c:
            pairs = [pair(t) for t in self._resolve_all(rel.target, c["connect"])]
            there = self.snapshot.scan(junction.name)
            keys = list(pairs[0])
            held = {tuple(r[k] for k in keys) for r in map(plain, there.where(all_of(F.col(k) == F.lit(v) for k, v in own.items())).select(*keys).join(F.broadcast(there.sparkSession.createDataFrame([tuple(p[k] for k in keys) for p in pairs], there.select(*keys).schema)), keys, "left_semi").collect())}
            fresh = [p for p in pairs if tuple(p[k] for k in keys) not in held]
            if fresh:
                write.insert(fresh)

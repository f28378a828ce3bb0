"""Inserts, updates, upserts and deletes as set operations that make a table's next version."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphlake.errors import fail, violation
from graphlake.operators.order import sort_columns, with_key
from graphlake.operators.read import plain
from graphlake.operators.where import all_of
from graphlake.schema import Table
from graphlake.sources.store import file_name
from graphlake.values import UNSET, given

#: Small inputs that are broadcast: rows given as Python values are at most this many.
BROADCAST_ROWS = 100_000


def lit(v: Any) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


class Writer:
    """Writes to one table of a snapshot. ``reader`` gives projections of the rows written."""

    def __init__(self, table: Table, schema, snapshot, compiler, reader):
        self.table, self.schema, self.snapshot, self.compiler, self.reader = table, schema, snapshot, compiler, reader

    @property
    def current(self) -> DataFrame:
        return self.snapshot.scan(self.table.name)

    # input

    def frame(self, data: Any, *, complete: bool = True) -> DataFrame:
        """The rows to write, typed, with ``__i``, their order. ``complete``: fill in defaults and NULLs."""
        t = self.table
        if isinstance(data, DataFrame):
            self._known(data.columns)
            df = data.withColumn("__i", F.monotonically_increasing_id())
            if complete:
                df = df.select("__i", *(F.col(k) if k in data.columns else lit(c.make_default()).alias(k) for k, c in t.columns.items()))
            df = df.select("__i", *(F.col(k).cast(t.columns[k].dtype).alias(k) for k in df.columns if k != "__i"))
            return self.snapshot.store.held(df, f"{t.name}-input")  # the caller's frame may give other rows next time
        rows = [given(r) for r in data]
        for r in rows:
            self._known(r)
        keys = list(t.columns) if complete else [k for k in t.columns if any(k in r for r in rows)]
        filled = [tuple(r[k] if k in r else t.columns[k].make_default() for k in keys) for r in rows]
        fields = [f for f in t.schema.fields if f.name in keys]
        schema = T.StructType([T.StructField("__i", T.LongType()), *fields])
        return self.snapshot.store.spark.createDataFrame([(i, *r) for i, r in enumerate(filled)], schema)

    def _known(self, keys) -> None:
        for k in keys:
            if k not in self.table.columns:
                raise fail(f'Unknown column "{k}" in data for {self.table.name}')
            if self.table.columns[k].generated:
                raise fail(f'Column "{k}" of {self.table.name} is generated')

    def check_not_null(self, rows: DataFrame) -> None:
        must = [k for k in rows.columns if k in self.table.columns and not self.table.columns[k].nullable]
        if must:
            broken = rows.agg(*(F.bool_or(F.col(k).isNull()).alias(k) for k in must)).first()
            for k in must:
                if broken[k]:
                    raise violation("notNull", f"NOT NULL constraint failed: {self.table.name}.{k}", table=self.table.name, column=k)

    def _on(self, key: tuple[str, ...], left: str, right: str) -> Column:
        return all_of(F.col(f"{left}.{k}") == F.col(f"{right}.{k}") for k in key)

    def _clash(self, rows: DataFrame, existing: DataFrame, key: tuple[str, ...]) -> bool:
        given_rows = rows.where(all_of(F.col(k).isNotNull() for k in key))
        if not given_rows.groupBy(*key).count().where("count > 1").isEmpty():
            return True
        return not given_rows.alias("n").join(existing.alias("e"), self._on(key, "n", "e"), "left_semi").isEmpty()

    def check_unique(self, rows: DataFrame, existing: DataFrame, keys: list[tuple[str, ...]]) -> None:
        for key in keys:
            if self._clash(rows, existing, key):
                raise violation("unique", f"UNIQUE constraint failed: {', '.join(f'{self.table.name}.{k}' for k in key)}", table=self.table.name, columns=list(key))

    def conflict_keys(self, skip: Any) -> list[tuple[str, ...]]:
        """The keys whose conflicts are skipped: all for True, the one named for a list."""
        if not skip:
            return []
        if skip is True:
            return self.table.keys
        for k in skip:
            if k not in self.table.columns:
                raise fail(f'Unknown column "{k}" in skipDuplicates')
        return [tuple(skip)]

    # insert

    def insert(self, data: Any, skip: Any = None) -> DataFrame:
        """Append rows and return those that were. Conflicts on skipped keys keep the row that is there, or
        that comes first; other conflicts are errors."""
        rows = self.frame(data)
        self.check_not_null(rows)
        skipped = self.conflict_keys(skip)
        for key in skipped:
            w = Window.partitionBy(*key).orderBy("__i")
            free = all_of(F.col(k).isNotNull() for k in key)
            rows = rows.withColumn("__d", F.row_number().over(w)).where((F.col("__d") == 1) | ~free).drop("__d")
            rows = rows.alias("n").join(self.current.alias("e"), self._on(key, "n", "e"), "left_anti")
        self.check_unique(rows, self.current, [k for k in self.table.keys if k not in skipped])
        self.snapshot.append(self.table, rows.drop("__i"))
        return rows

    # update and delete

    def _scope(self, where: Any, also: Any = None) -> tuple[DataFrame, list[str] | None]:
        """(the rows of the files that hold matching rows, the other files); all rows and None where the table isn't
        as its files are. ``also`` narrows a frame of matching rows further."""
        name = self.table.name
        files = self.snapshot.files.get(name)
        if files is None:
            return self.current, None
        a = self.compiler.alias()
        rows = self.snapshot.store.scan_files(name, files).select("*", F.col("_metadata.file_path").alias("__file")).alias(a) if files else None
        if rows is None:
            return self.current, []
        cond = self.compiler.compile(self.table, where, a)
        rows = rows if cond is None else rows.where(cond)
        rows = rows.select(*(F.col(f"{a}.{c}").alias(c) for c in (*self.table.columns, "__file")))
        hit = {file_name(r[0]) for r in (rows if also is None else also(rows)).select("__file").distinct().collect()}
        touched = [f for f in files if f in hit]
        if len(touched) != len(hit):
            return self.current, None  # the files go by other names than those listed
        return self.snapshot.store.scan_files(name, touched), [f for f in files if f not in hit]

    def _replace(self, kept: list[str] | None, rows: DataFrame) -> None:
        if kept is None or kept != self.snapshot.files.get(self.table.name):  # else no file holds a matching row
            self.snapshot.replace(self.table, kept, rows)

    def _split(self, where: Any, rows: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """(matching rows, the others), of all or of those given."""
        a = self.compiler.alias()
        rows = self.current if rows is None else rows
        df = rows.alias(a)
        cond = self.compiler.compile(self.table, where, a)
        cols = [F.col(f"{a}.{c}").alias(c) for c in self.table.columns]
        if cond is None:
            return rows, rows.where(F.lit(False))
        return df.where(cond).select(*cols), df.where(~F.coalesce(cond, F.lit(False))).select(*cols)

    def assign(self, where: Any, values: dict[str, Any]) -> tuple[DataFrame, DataFrame]:
        """Set columns of the matching rows; (the rows as they were, as they are now)."""
        self._known(values)
        touched = [key for key in self.table.keys if set(key) & set(values)]
        scope, kept = (self.current, None) if touched else self._scope(where)
        before, rest = self._split(where, scope)
        after = before.select(*((lit(values[k]).cast(c.dtype).alias(k) if k in values else F.col(k)) for k, c in self.table.columns.items()))
        if any(k in values for k, c in self.table.columns.items() if not c.nullable):
            self.check_not_null(after.select(*[k for k in values if k in self.table.columns]))
        self.check_unique(after, rest, touched)
        self._replace(kept, rest.unionByName(after))
        return before, after

    def remove(self, where: Any) -> DataFrame:
        scope, kept = self._scope(where)
        gone, rest = self._split(where, scope)
        self._replace(kept, rest)
        return gone

    def first(self, rows: DataFrame) -> dict | None:
        """The first row by key: DataFrames have no order of their own."""
        found = rows.orderBy(*sort_columns(with_key(self.table, []))).limit(1).collect()
        return plain(found[0]) if found else None

    def shown(self, row: dict | None, args: dict) -> dict | None:
        """A written row under the projection asked for, read from the new version."""
        if row is None or not (given(args.get("select")) or given(args.get("include"))):
            return row
        by = {k: row[k] for k in (self.table.primary_key or self.table.columns)}
        return self.reader.find_first({"where": by, **{k: args[k] for k in ("select", "include") if k in args}}).value()

    # many rows with values of their own

    def _columns_of(self, data: DataFrame, by: tuple[str, ...], update: Any) -> list[str]:
        cols = [c for c in data.columns if c not in (*by, "__i")] if update in (None, UNSET, "all") else list(update)
        for c in cols:
            if c not in self.table.columns:
                raise fail(f'Unknown column "{c}" in update')
        return cols

    def _small(self, data: Any, df: DataFrame) -> DataFrame:
        return df if isinstance(data, DataFrame) or len(data) > BROADCAST_ROWS else F.broadcast(df)

    def update_each(self, args: dict) -> dict:
        by, data, resolver = args.get("by"), args.get("data"), args.get("update")
        if not isinstance(by, str) or by not in self.table.columns:
            raise fail("updateEach takes a column as by")
        if not isinstance(data, DataFrame):
            data = list(data or [])
            if not data:
                if args.get("onEmpty") == "throw":
                    raise fail("updateEach has no data")
                return {"count": 0}
            values = [r.get(by) for r in data]
            if any(v is None for v in values):
                raise fail(f'updateEach: every row needs "{by}"')
            if len(set(values)) != len(values):
                raise fail(f'updateEach: a value of "{by}" is repeated')
            if callable(resolver):
                resolved = [resolver(r) for r in data]
                if any(r is None or r is UNSET for r in resolved):
                    raise fail("updateEach: the resolver returned nothing")
                data, resolver = [{by: v, **given(r)} for v, r in zip(values, resolved)], None
        elif not data.groupBy(by).count().where(f"count > 1 or `{by}` is null").isEmpty():
            raise fail(f'updateEach: "{by}" is repeated or missing')
        rows = self.frame(data, complete=False)
        cols = self._columns_of(rows, (by,), resolver)
        if not cols:
            raise fail("updateEach has no columns to set")
        src = rows.select(F.col(by).alias("__by"), *(F.col(c).alias(f"__x_{c}") for c in cols), *self._presence(data, cols, rows))
        touched = [k for k in self.table.keys if set(k) & set(cols)]
        small = self._small(data, src)
        scope, kept = (self.current, None) if touched else self._scope(args.get("where"), lambda df: df.join(small, F.col(by) == F.col("__by"), "left_semi"))
        before, rest = self._split(args.get("where"), scope)
        joined = before.join(small, F.col(by) == F.col("__by"), "left")
        hit = F.col("__by").isNotNull()
        after = joined.select(*((F.when(hit & F.col(f"__g_{c}"), F.col(f"__x_{c}")).otherwise(F.col(c)).alias(c) if c in cols else F.col(c)) for c in self.table.columns), hit.alias("__hit"))
        changed = after.where("__hit").drop("__hit")
        self.check_not_null(changed.select(*cols))
        new = after.drop("__hit")
        self.check_unique(new, rest, touched)
        count = changed.count()
        self._replace(kept, rest.unionByName(new))
        out: dict[str, Any] = {"count": count}
        if given(args.get("select")):
            out["data"] = [plain(r) for r in self.reader.graph.project(self.table, changed, {"select": args["select"]}, few=True).collect()]
        return out

    def _presence(self, data: Any, cols: list[str], rows: DataFrame) -> list[Column]:
        """Whether each row gives each column: a row of Python values may leave some out."""
        if isinstance(data, DataFrame) or all(c in r for r in data for c in cols):
            return [F.lit(True).alias(f"__g_{c}") for c in cols]
        lacking = {c: [i for i, r in enumerate(data) if c not in r] for c in cols}
        return [(~F.col("__i").isin(x) if x else F.lit(True)).alias(f"__g_{c}") for c, x in lacking.items()]

    def upsert_many(self, args: dict) -> dict:
        data, target, update = args.get("data"), args.get("target"), args.get("update", "all")
        if not isinstance(data, DataFrame):
            data = list(data or [])
            if not data:
                return {"count": 0}
        size = args.get("batchSize")
        if size not in (None, UNSET) and (not isinstance(size, int) or isinstance(size, bool) or size < 1):
            raise fail("batchSize is a positive whole number")
        target = (target,) if isinstance(target, str) else tuple(target or self.table.primary_key)
        if not target or any(t not in self.table.columns for t in target):
            raise fail("upsertMany takes columns of the table as target")
        if any(k in self.table.relations for k in given(args.get("select"))):
            raise fail("upsertMany selects columns only")
        rows = self.frame(data)
        self.check_not_null(rows)
        if not rows.groupBy(*target).count().where("count > 1").isEmpty():
            raise violation("unique", "upsertMany: a conflict target is repeated in the data", columns=list(target))
        x, own = "__x", self.compiler.alias()
        src = self._small(data, rows.select(*(F.col(k).alias(f"{x}_{k}") for k in self.table.columns), F.lit(True).alias(f"{x}__")))
        excluded = {k: F.col(f"{x}_{k}") for k in self.table.columns}
        if callable(update):
            update = update({"excluded": excluded, "table": {k: F.col(f"{own}.{k}") for k in self.table.columns}})
        if isinstance(update, dict):
            values = {k: lit(v) for k, v in given(update).items()}
            self._known(values)
        else:
            values = {c: excluded[c] for c in ([k for k in self.table.columns if k not in target] if update == "all" else self._columns_of(rows, target, update))}
        if not values:
            raise fail("upsertMany has nothing to update")
        touched = [k for k in self.table.keys if k != target]
        on = lambda df: df.join(src, all_of(F.col(t) == F.col(f"{x}_{t}") for t in target), "left_semi")
        scope, untouched = (self.current, None) if touched else self._scope(None, on)
        joined = scope.alias(own).join(src, all_of(F.col(f"{own}.{t}") == F.col(f"{x}_{t}") for t in target), "left")
        hit = F.col(f"{x}__").isNotNull()
        gate = self.compiler.compile(self.table, args.get("where"), own)
        if gate is not None:
            hit = hit & F.coalesce(gate, F.lit(False))
        kept = joined.select(*((F.when(hit, values[k]).otherwise(F.col(f"{own}.{k}")).cast(c.dtype) if k in values else F.col(f"{own}.{k}")).alias(k) for k, c in self.table.columns.items()), hit.alias("__hit"))
        fresh = rows.drop("__i").alias("n").join(scope.alias("e"), self._on(target, "n", "e"), "left_anti")
        self.check_not_null(kept.where("__hit").select(*values))
        self.check_unique(fresh, kept, touched)
        self.check_unique(kept, fresh, [k for k in touched if set(k) & set(values)])
        affected = kept.where("__hit").drop("__hit").unionByName(fresh)
        count = affected.count()
        self.snapshot.replace(self.table, untouched, kept.drop("__hit").unionByName(fresh))
        out: dict[str, Any] = {"count": count}
        if given(args.get("select")):
            out["data"] = [plain(r) for r in self.reader.graph.project(self.table, affected, {"select": args["select"]}, few=True).collect()]
        return out

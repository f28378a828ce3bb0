"""Clients, delegates (one per table), transactions and raw SQL."""

from __future__ import annotations

import re
import threading
import time
from collections.abc import Callable
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from graphlake.errors import EngineError, ErrorCode, fail
from graphlake.hooks import FAMILY, HOOKS, Operation, Plugin, call_hook, check_plugins, run_pipeline
from graphlake.operators.read import Reader, Result, plain
from graphlake.operators.relwrite import RelationWriter, check_commands, split_data
from graphlake.operators.where import WhereCompiler
from graphlake.operators.write import Writer
from graphlake.schema import Schema, Table
from graphlake.sources.store import ConcurrentWrite, Snapshot, TableStore
from graphlake.values import UNSET, given

DIALECT = "spark"
#: Held while a client's tables stand for the session's views.
_VIEWS = threading.RLock()
LAZY = {"findMany", "findFirst", "findOne", "findUnique", "count", "exists", "paginate", "cursor"}
LOCK_MODES = {"update", "noKeyUpdate", "share", "keyShare"}


def check_lock(lock: Any, args: dict, in_transaction: bool, schema: Schema) -> None:
    """Row locks have no counterpart: their arguments are checked, then they are refused."""
    if lock in (None, UNSET):
        return
    spec = {"mode": lock} if isinstance(lock, str) else lock
    if not isinstance(spec, dict) or spec.get("mode", "update") not in LOCK_MODES:
        raise fail("Unknown lock mode")
    if spec.get("noWait") and spec.get("skipLocked"):
        raise fail("noWait and skipLocked exclude each other")
    for t in spec.get("tables") or []:
        schema.table(t)
    if not in_transaction:
        raise EngineError(ErrorCode.LOCK_REQUIRES_TRANSACTION, "Row locks need a transaction")
    if given(args.get("include")):
        raise EngineError(ErrorCode.LOCK_NOT_SUPPORTED, "Row locks can't be combined with include")
    raise EngineError(ErrorCode.LOCK_NOT_SUPPORTED, "Spark has no row locks")


class Delegate:
    """The operations of one table. Arguments are a dict, keywords, or both."""

    def __init__(self, client: Client, table: Table):
        self._client, self.table = client, table
        for name, fn in client._model_extensions(table).items():
            setattr(self, name, fn)

    def _op(self, kind: str, args: dict | None, kw: dict) -> Any:
        return self._client._run(kind, self.table, given({**(args or {}), **kw}))

    def with_state(self, **state: Any) -> Delegate:
        """The delegate with more plugin state."""
        return self._client._scoped(state=self._client.state | state)._delegate(self.table)

    def without_plugins(self) -> Delegate:
        return self._client._scoped(plugins_on=False)._delegate(self.table)

    def find_many(self, args=None, **kw) -> Result:
        return self._op("findMany", args, kw)

    def find_first(self, args=None, **kw) -> Result:
        return self._op("findFirst", args, kw)

    def find_one(self, args=None, **kw) -> Result:
        return self._op("findOne", args, kw)

    def find_unique(self, args=None, **kw) -> Result:
        return self._op("findUnique", args, kw)

    def count(self, args=None, **kw) -> Result:
        return self._op("count", args, kw)

    def exists(self, args=None, **kw) -> Result:
        return self._op("exists", args, kw)

    def paginate(self, args=None, **kw) -> Result:
        return self._op("paginate", args, kw)

    def cursor(self, args=None, **kw) -> Result:
        return self._op("cursor", args, kw)

    def create(self, args=None, **kw) -> dict | None:
        return self._op("create", args, kw)

    def create_many(self, args=None, **kw) -> dict:
        return self._op("createMany", args, kw)

    def update(self, args=None, **kw) -> dict | None:
        return self._op("update", args, kw)

    def update_many(self, args=None, **kw) -> dict:
        return self._op("updateMany", args, kw)

    def update_each(self, args=None, **kw) -> dict:
        return self._op("updateEach", args, kw)

    def delete(self, args=None, **kw) -> dict | None:
        return self._op("delete", args, kw)

    def delete_many(self, args=None, **kw) -> dict:
        return self._op("deleteMany", args, kw)

    def upsert(self, args=None, **kw) -> dict:
        return self._op("upsert", args, kw)

    def upsert_many(self, args=None, **kw) -> dict:
        return self._op("upsertMany", args, kw)

    findMany, findFirst, findOne, findUnique = find_many, find_first, find_one, find_unique
    createMany, updateMany, updateEach, deleteMany, upsertMany = create_many, update_many, update_each, delete_many, upsert_many


class _Transaction:
    """State shared by the clients of one transaction."""

    def __init__(self, snapshot: Snapshot, options: dict, parent: _Transaction | None):
        self.snapshot, self.parent = snapshot, parent
        self.depth = parent.depth + 1 if parent else 1
        timeout = options.get("timeoutMs")
        self.deadline = time.monotonic() + timeout / 1000 if timeout else None
        self.signal: threading.Event | None = options.get("signal")
        self.commit_calls: list[Callable] = []
        self.rollback_calls: list[Callable] = []

    def check(self) -> None:
        if self.signal is not None and self.signal.is_set():
            raise EngineError(ErrorCode.TRANSACTION_ABORTED, "The transaction was aborted")
        if self.deadline is not None and time.monotonic() > self.deadline:
            raise EngineError(ErrorCode.TRANSACTION_TIMEOUT, "The transaction took longer than its limit")
        if self.parent:
            self.parent.check()


#: What a transaction may be retried for, by words in the error (fixed values).
RETRY_REASONS = {
    "deadlock": ("deadlock", "40p01"),
    "serializationFailure": ("could not serialize", "serialization failure", "concurrent", "40001"),
    "connectionError": ("connection refused", "connection reset", "connection closed", "connection terminated", "econnreset"),
}


def retry_reason(error: BaseException | None) -> str | None:
    while error is not None:
        text = f"{type(error).__name__} {error}".lower()
        for reason, words in RETRY_REASONS.items():
            if any(w in text for w in words):
                return reason
        error = error.__cause__
    return None


class Client:
    """Tables are attributes and items; so are client extensions."""

    def __init__(self, store: TableStore, options: dict):
        self.store, self.schema, self.spark = store, store.schema, store.spark
        self.options = options
        self.hooks: dict[str, Callable] = options.get("hooks") or {}
        if unknown := set(self.hooks) - set(HOOKS):
            raise fail("Unknown hooks: " + ", ".join(sorted(unknown)))
        self.plugins: list[Plugin] = list(options.get("plugins") or [])
        self.meta: dict = dict(options.get("context") or {})
        self.state: dict = {}
        self.plugins_on = True
        self.tx: _Transaction | None = None
        self._extensions: list[Callable] = list(options.get("_extensions") or [])
        self._delegates: dict[str, Delegate] = {}
        self._extended: dict[str, Any] = {}
        self._extend()

    @classmethod
    def open(cls, spark: SparkSession, schema: Schema, sources: dict, **options: Any) -> Client:
        store = TableStore(spark, schema, sources, path=options.get("path"), cut_after=options.get("cut_after", 12))
        check_plugins(list(options.get("plugins") or []), schema)
        client = cls(store, options)
        for p in client.plugins:
            if p.setup:
                p.setup(client)
        return client

    # scopes and extensions

    def _scoped(self, **changes: Any) -> Client:
        new = object.__new__(Client)
        new.__dict__.update(self.__dict__, _delegates={}, _extended={})
        new.__dict__.update(changes)
        new._extend()
        return new

    def with_context(self, **meta: Any) -> Client:
        """A client whose operations carry more metadata."""
        return self._scoped(meta=self.meta | meta)

    def without_plugins(self) -> Client:
        return self._scoped(plugins_on=False)

    def extends(self, extension: Callable[[Client], dict]) -> Client:
        """A client with more functions, also in its scopes and transactions."""
        return self._scoped(_extensions=[*self._extensions, extension])

    def _extend(self) -> None:
        for owner, fn in [(p.id, p.extend_client) for p in self.plugins if p.extend_client] + [("extension", e) for e in self._extensions]:
            for name, value in (fn(self) or {}).items():
                if name in self._extended or name in self.schema.tables or hasattr(Client, name):
                    raise EngineError(ErrorCode.PLUGIN_EXTENSION_CONFLICT, f'{owner}: the client already has "{name}"')
                self._extended[name] = value

    def _model_extensions(self, table: Table) -> dict[str, Any]:
        out: dict[str, Any] = {}
        for p in self.plugins:
            for name, fn in ((p.extend_model(self, table) if p.extend_model else None) or {}).items():
                if name in out or hasattr(Delegate, name):
                    raise EngineError(ErrorCode.PLUGIN_EXTENSION_CONFLICT, f'{p.id}: {table.name} already has "{name}"')
                out[name] = fn
        return out

    def _delegate(self, table: Table) -> Delegate:
        if table.name not in self._delegates:
            self._delegates[table.name] = Delegate(self, table)
        return self._delegates[table.name]

    def repository(self, name: str) -> Delegate:
        try:
            return self._delegate(self.schema.table(name))
        except EngineError as e:
            raise EngineError(ErrorCode.REPOSITORY_NOT_FOUND, f'No repository "{name}"', cause=e) from e

    def __getattr__(self, name: str) -> Any:
        own = self.__dict__
        if name in own.get("_extended", {}):
            return own["_extended"][name]
        if "schema" in own and name in own["schema"].tables:
            return self._delegate(own["schema"].tables[name])
        raise AttributeError(name)

    def __getitem__(self, name: str) -> Delegate:
        return self.repository(name)

    # operations

    def _tools(self, snapshot: Snapshot):
        lenient, escape = self.options.get("lenient", False), self.options.get("escape_like", False)
        compiler = WhereCompiler(self.schema, snapshot.scan, lenient=lenient, escape_like=escape)

        def reader(name: str) -> Reader:
            return Reader(self.schema.table(name), self.schema, snapshot.scan, compiler, lenient=lenient)

        def writer(name: str) -> Writer:
            return Writer(self.schema.table(name), self.schema, snapshot, compiler, reader(name))

        return reader, writer, RelationWriter(self.schema, snapshot, writer, reader)

    def _run(self, kind: str, table: Table, args: dict) -> Any:
        if self.tx:
            self.tx.check()
        if not self.tx and kind in ("create", "update", "upsert") and self._relational(table, kind, args):
            return self.transaction(lambda tx: tx._run(kind, table, args))
        meta = self.meta | (args.get("meta") or {})
        op = Operation(kind, table.name, {k: v for k, v in args.items() if k != "meta"}, meta, dict(self.state), self, self.tx is not None)
        plugins = self.plugins if self.plugins_on else []
        try:
            return run_pipeline(op, plugins, self.hooks, lambda o, after: self._execute(o, table, after), kind in LAZY)
        except Exception as e:
            error = EngineError.of(e, ErrorCode.OPERATION_ERROR)
            self._report("onError", error, op)
            raise error from (e if error is not e else e.__cause__)

    def _report(self, hook: str, error: EngineError, subject: Any) -> None:
        if not getattr(error, "_reported", False):
            error._reported = True  # type: ignore[attr-defined]
            if hook in self.hooks:
                self.hooks[hook](error, subject)

    def _relational(self, table: Table, kind: str, args: dict) -> bool:
        parts = [args.get("data")] if kind != "upsert" else [args.get("create"), args.get("update")]
        return any(k in table.relations or k in table.ambiguous for p in parts if isinstance(p, dict) for k in p)

    def _execute(self, op: Operation, table: Table, after) -> Any:
        snapshot = self.tx.snapshot if self.tx else self.store.snapshot()
        reader, writer, related = self._tools(snapshot)
        args = op.args
        if op.kind in LAZY:
            check_lock(args.get("lock"), args, self.tx is not None, self.schema)
            read = reader(table.name)
            fn = {"findMany": read.find_many, "count": read.count, "exists": read.exists, "paginate": read.paginate, "cursor": read.cursor}.get(op.kind, read.find_first)
            return fn(args, after)
        out = getattr(self, f"_{op.kind}")(table, args, writer(table.name), related)
        if not self.tx:
            try:
                snapshot.commit()
            except ConcurrentWrite as e:
                raise EngineError(ErrorCode.DATABASE_ERROR, f"could not serialize: {e} was changed meanwhile", cause=e) from e
        return out

    def _create(self, table: Table, args: dict, w: Writer, related: RelationWriter) -> dict | None:
        values, commands = split_data(self.schema, table, args.get("data") or {})
        check_commands(commands, creating=True)
        values |= related.own_keys(table, commands)
        row = w.first(w.insert([values], args.get("skipDuplicates")))
        if row is None:
            return None
        row.pop("__i", None)
        related.apply(table, row, commands)
        return w.shown(row, args)

    def _createMany(self, table: Table, args: dict, w: Writer, related: RelationWriter) -> dict:
        data = args.get("data")
        if not isinstance(data, DataFrame) and not data:
            return {"count": 0}
        rows = w.insert(data, args.get("skipDuplicates"))
        if isinstance(data, DataFrame):
            return {"count": rows.count()}
        shown = w.reader.graph.project(table, rows, {k: args[k] for k in ("select", "include") if k in args}, few=True, keep=("__i",)).orderBy("__i").drop("__i")
        out = [plain(r) for r in shown.collect()]
        return {"count": len(out), "data": out}

    def _update(self, table: Table, args: dict, w: Writer, related: RelationWriter) -> dict | None:
        where = args.get("where")
        if not isinstance(where, dict) or not given(where):
            return None
        values, commands = split_data(self.schema, table, args.get("data") or {})
        if commands:
            check_commands(commands, creating=False)
            found = w.reader.find_many({"where": where, "take": 2}).value()
            if len(found) != 1:
                raise fail(f"update with relations must match one row of {table.name}, not {'none' if not found else 'several'}")
            where = {k: found[0][k] for k in (table.primary_key or table.columns)}
            values |= related.own_keys(table, commands)
            row = found[0]
            if values:
                row = w.first(w.assign(where, values)[1])
            related.apply(table, row, commands)
            return w.shown(row, args)
        if not values:
            return None
        return w.shown(w.first(w.assign(where, values)[1]), args)

    def _updateMany(self, table: Table, args: dict, w: Writer, related: RelationWriter) -> dict:
        where = args.get("where")
        if where in (None, UNSET) or where == {} or not given(args.get("data")):
            return {"count": 0}
        return {"count": w.assign(where, given(args["data"]))[0].count()}

    def _updateEach(self, table: Table, args: dict, w: Writer, related: RelationWriter) -> dict:
        return w.update_each(args)

    def _delete(self, table: Table, args: dict, w: Writer, related: RelationWriter) -> dict | None:
        where = args.get("where")
        if where in (None, UNSET) or where == {}:
            return None
        row = w.first(w.reader.matching({"where": where})[0])
        row = w.shown(row, args)  # the projection is of the row before it goes
        w.remove(where)
        return row

    def _deleteMany(self, table: Table, args: dict, w: Writer, related: RelationWriter) -> dict:
        where = args.get("where")
        if where in (None, UNSET) or where == {}:
            return {"count": 0}
        return {"count": w.remove(where).count()}

    def _upsert(self, table: Table, args: dict, w: Writer, related: RelationWriter) -> dict:
        if given(args.get("where")) and w.reader.exists({"where": args["where"]}).value():
            shape = {k: args[k] for k in ("select", "include") if k in args}
            found = self._update(table, {"where": args["where"], "data": args.get("update") or {}, **shape}, w, related)
            return found if found is not None else w.shown(w.first(w.reader.matching({"where": args["where"]})[0]), args)
        return self._create(table, {**args, "data": args.get("create") or {}}, w, related)

    def _upsertMany(self, table: Table, args: dict, w: Writer, related: RelationWriter) -> dict:
        return w.upsert_many(args)

    # transactions

    def _transaction_options(self, options: dict) -> dict:
        unsupported = [k for k in ("isolationLevel", "readOnly", "comment") if options.get(k) not in (None, False)]
        mode = options.get("unsupportedOptions", self.options.get("unsupported_transaction_options", "warn"))
        if unsupported and mode == "throw":
            raise EngineError(ErrorCode.TRANSACTION_UNSUPPORTED_OPTION, "Not supported: " + ", ".join(unsupported))
        if unsupported and mode == "warn":
            import warnings

            warnings.warn("Transaction options without effect: " + ", ".join(unsupported), stacklevel=3)
        return options

    def transaction(self, work: Callable[[Client], Any], **options: Any) -> Any:
        """Run ``work`` with a client of its own: its writes appear together when it returns, or not at all.
        Inside another transaction it is a savepoint. ``retry``: {"attempts", "on", "delayMs"}."""
        options = self._transaction_options(options)
        retry = options.get("retry") or {}
        attempts, reasons = max(1, int(retry.get("attempts", 1))), retry.get("on") or list(RETRY_REASONS)
        attempt = 1
        while True:
            try:
                return self._attempt(work, options)
            except Exception as e:
                if attempt >= attempts or retry_reason(e) not in reasons:
                    raise
                delay = retry.get("delayMs", 0)
                time.sleep((delay(attempt) if callable(delay) else delay) / 1000)
                attempt += 1

    def _attempt(self, work: Callable[[Client], Any], options: dict) -> Any:
        parent = self.tx
        snapshot = parent.snapshot if parent else self.store.snapshot()
        tx = _Transaction(snapshot, options, parent)
        mark = snapshot.mark()
        client = self._scoped(tx=tx, meta=self.meta | (options.get("context") or {}))
        try:
            tx.check()
            for p in self.plugins if self.plugins_on else []:
                call_hook(p.hooks, "beforeTransaction", Operation("transaction", None, {}, client.meta, dict(self.state), client, parent is not None), p.id)
            call_hook(self.hooks, "beforeTransaction", client)
            out = work(client)
            tx.check()
            if not parent:
                try:
                    snapshot.commit()
                except ConcurrentWrite as e:
                    raise EngineError(ErrorCode.DATABASE_ERROR, f"could not serialize: {e} was changed meanwhile", cause=e) from e
        except BaseException as e:
            snapshot.restore(mark)
            for fn in tx.rollback_calls:
                fn()
            call_hook(self.hooks, "afterTransactionRollback", client)
            if isinstance(e, Exception):
                error = EngineError.of(e, ErrorCode.UNKNOWN)
                if error.code != ErrorCode.TRANSACTION_ROLLBACK:
                    if not getattr(error, "_tx_reported", False) and "onTransactionError" in self.hooks:
                        error._tx_reported = True  # type: ignore[attr-defined]
                        self.hooks["onTransactionError"](error, client)
            raise
        if parent:
            parent.commit_calls += tx.commit_calls
            parent.rollback_calls += tx.rollback_calls
        else:
            call_hook(self.hooks, "afterTransactionCommit", client)
            for fn in tx.commit_calls:
                fn()
        return out

    def rollback(self, reason: str = "rolled back") -> None:
        raise EngineError(ErrorCode.TRANSACTION_ROLLBACK, reason)

    def after_commit(self, fn: Callable[[], Any]) -> None:
        if not self.tx:
            raise EngineError(ErrorCode.AFTER_COMMIT_OUTSIDE_TRANSACTION, "after_commit needs a transaction")
        self.tx.commit_calls.append(fn)

    def after_rollback(self, fn: Callable[[], Any]) -> None:
        if not self.tx:
            raise EngineError(ErrorCode.AFTER_ROLLBACK_OUTSIDE_TRANSACTION, "after_rollback needs a transaction")
        self.tx.rollback_calls.append(fn)

    # raw SQL

    def _guard_raw(self, unsafe: bool, options: dict) -> None:
        rules = self.options.get("raw") or {}
        if rules.get("enabled") is False:
            raise EngineError(ErrorCode.RAW_DISABLED, "Raw SQL is disabled")
        if unsafe and not rules.get("allowUnsafe"):
            raise EngineError(ErrorCode.RAW_UNSAFE_DISABLED, "raw_unsafe is disabled")
        if rules.get("requireComment") and not options.get("comment"):
            raise EngineError(ErrorCode.RAW_COMMENT_REQUIRED, "Raw SQL needs a comment")

    @contextmanager
    def _views(self):
        """The snapshot's tables as temporary views, under their keys and storage names, while a query is resolved;
        the session's own views of these names come back."""
        snapshot = self.tx.snapshot if self.tx else self.store.snapshot()
        views = {n: df for name, df in snapshot.frames.items() for n in (name, self.schema.tables[name].source) if n}
        catalog = self.spark._jsparkSession.sessionState().catalog()
        with _VIEWS:
            before = {n: catalog.getRawTempView(n) for n in views}
            try:
                for n, df in views.items():
                    df.createOrReplaceTempView(n)
                yield snapshot
            finally:
                for n, old in before.items():
                    if old.isDefined():
                        catalog.createTempView(n, old.get(), True)
                    else:
                        self.spark.catalog.dropTempView(n)

    def raw_frame(self, sql: str, params: dict | list | None = None) -> DataFrame:
        """The query's DataFrame; parameters are bound by name (:a) or place (?), never spliced in."""
        with self._views():
            return self.spark.sql(sql, args=params or None)

    def _raw(self, kind: str, sql: Any, params: Any, options: dict, run: Callable[[str], Any], unsafe: bool = False) -> Any:
        self._guard_raw(unsafe, options)
        if not isinstance(sql, str) or not sql.strip():
            raise EngineError(ErrorCode.RAW_INVALID_QUERY, "Raw SQL is a non-empty string")
        if self.tx:
            self.tx.check()
        if options.get("signal") is not None and options["signal"].is_set():
            raise EngineError(ErrorCode.RAW_ABORTED, "The query was aborted")
        for p in self.plugins if self.plugins_on else []:
            if "beforeRaw" in p.hooks:
                call_hook(p.hooks, "beforeRaw", Operation(kind, None, {"sql": sql, "params": params, **options}, self.meta, dict(self.state), self, self.tx is not None), p.id)
        subject = {"kind": kind, "sql": sql, "params": params, "options": options, "meta": self.meta}
        call_hook(self.hooks, "beforeRaw", subject)
        if options.get("comment"):
            sql = f"/* {str(options['comment']).replace('*/', '* /')} */ {sql}"
        try:
            out = self._limited(lambda: run(sql), options)
        except Exception as e:
            error = EngineError.of(e, ErrorCode.DATABASE_ERROR)
            self._report("onRawError", error, subject)
            raise error from e
        call_hook(self.hooks, "afterRaw", subject | {"result": out})
        return out

    def _limited(self, run: Callable[[], Any], options: dict) -> Any:
        """Run under a job tag that a timer or an abort signal cancels."""
        timeout, signal = options.get("timeoutMs"), options.get("signal")
        if not timeout and signal is None:
            return run()
        tag, over, why = f"graphlake-{id(run)}", threading.Event(), []
        sc = self.spark.sparkContext
        sc.addJobTag(tag)

        def watch() -> None:
            end = time.monotonic() + timeout / 1000 if timeout else None
            while not over.wait(0.02):
                if signal is not None and signal.is_set():
                    why.append(ErrorCode.RAW_ABORTED)
                elif end is not None and time.monotonic() > end:
                    why.append(ErrorCode.RAW_TIMEOUT)
                if why:
                    while not over.wait(0.05):  # a query may start its jobs one after another
                        sc.cancelJobsWithTag(tag)
                    return

        thread = threading.Thread(target=watch, daemon=True)
        thread.start()
        try:
            out = run()
        except Exception as e:
            if why:
                raise EngineError(why[0], "The query was stopped", cause=e) from e
            raise
        finally:
            over.set()
            thread.join()
            sc.removeJobTag(tag)
        if why:
            raise EngineError(why[0], "The query was stopped")
        return out

    def raw(self, sql: str, params: dict | list | None = None, *, map: Callable[[dict], Any] | None = None, **options: Any) -> list:
        """The rows of a parameterised query."""
        def run(text: str) -> list:
            rows = [plain(r) for r in self.raw_frame(text, params).collect()]
            return [map(r) for r in rows] if map else rows

        return self._raw("raw", sql, params, options, run)

    def raw_unsafe(self, sql: str, params: list | None = None, *, map: Callable[[dict], Any] | None = None, **options: Any) -> list:
        """A query given as plain text, off unless allowed; the number of ? must be that of the parameters."""
        params = list(params or [])

        def run(text: str) -> list:
            marks = re.sub(r"'(?:[^'\\]|\\.|'')*'|\"[^\"]*\"|--[^\n]*|/\*.*?\*/", "", text, flags=re.S).count("?")
            if marks != len(params):
                raise EngineError(ErrorCode.RAW_UNSAFE_PLACEHOLDER_MISMATCH, f"{marks} placeholders for {len(params)} parameters")
            rows = [plain(r) for r in self.raw_frame(text, params).collect()]
            return [map(r) for r in rows] if map else rows

        return self._raw("rawUnsafe", sql, params, options, run, unsafe=True)

    def execute_raw(self, sql: str, params: dict | list | None = None, **options: Any) -> dict:
        """INSERT INTO t [(cols)] query, UPDATE t SET ... [WHERE ...] or DELETE FROM t [WHERE ...] on the store."""
        return self._raw("executeRaw", sql, params, options, lambda text: self._execute_raw(text, params))

    def _execute_raw(self, sql: str, params: Any) -> dict:
        from graphlake.plans.dml import run_dml

        with self._views() as snapshot:
            out = run_dml(self.spark, self.schema, snapshot, self._tools(snapshot)[1], sql, params)
        if not self.tx:
            snapshot.commit()
        return out


assert set(LAZY) == {k for k, v in FAMILY.items() if v == "Query"}

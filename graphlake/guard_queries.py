"""Queries for what guards and watches operations: rules, validation, hooks, locks, limits, raw SQL's switches.

Each makes a call that must be denied and one that must not; its rows are those of the second call, read from the
tables, with what denied the first in the column ``denied`` ("done" if nothing did). So a write that slipped through
shows in the rows as well.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlake.client import Client
from graphlake.domain import client
from graphlake.errors import EngineError
from graphlake.hooks import Plugin
from graphlake.plugins import rules, validation
from graphlake.values import UNSET

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_SUP = "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier"
_KEYS = "SELECT s_suppkey FROM supplier"
_key, _by, _less = {"s_suppkey": True}, {"s_suppkey": "asc"}, {"s_acctbal": {"lt": 0}}
_COUNT = "SELECT count(*) AS count FROM supplier"
_TOTALS = "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus"


def outcome(call: Callable[[], object]) -> str:
    """The rule, or else the code or the kind of violation, that denied a call."""
    try:
        call()
    except EngineError as e:
        return e.details.get("rule") or e.violation or e.code.value
    return "done"


def _denied(name: str, denied: str, bad: Callable[[Client], object], good: Callable[[Client], DataFrame], sql: str, **options) -> None:
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = client(spark, sf_dir, **{k: v() if callable(v) else v for k, v in options.items()})
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            why = outcome(lambda: bad(c))
            return good(c).withColumn("denied", F.lit(why))

    QUERIES[name], ORACLES[name] = build, f"SELECT *, '{denied}' AS denied FROM ({sql})"


def _state(c: Client) -> DataFrame:
    return c.supplier.find_many().df


def _then(work: Callable[[Client], object]) -> Callable[[Client], DataFrame]:
    """The suppliers after a write, read without rules."""
    return lambda c: (work(c), _state(c.without_plugins()))[1]


def _totals(rows: list[dict], c: Client) -> DataFrame:
    return c.spark.createDataFrame([(r["o_orderstatus"], r["n"]) for r in rows], "o_orderstatus string, n long")


# 2.14 rules: by name, their settings, a call against them, one that they let through, and its rows


def _rule(name: str, bad: Callable[[Client], object], good: Callable[[Client], DataFrame], sql: str, **settings) -> None:
    options = {name: {"level": "error", **settings} if settings else True}
    _denied(f"rule_{name}", name, bad, good, sql, plugins=lambda: [rules(options)], raw={"allowUnsafe": True})


def _set(cond: str, **to: str) -> str:
    return "SELECT " + ", ".join(f"CASE WHEN {cond} THEN {to[k]} ELSE {k} END AS {k}" if k in to else k for k in ("s_suppkey", "s_name", "s_nationkey", "s_acctbal")) + " FROM supplier"


_some = lambda c: c.supplier.find_many(where=_less, orderBy=_by, take=1000, select=_key).df
_SOME = f"{_KEYS} WHERE s_acctbal < 0 ORDER BY s_suppkey LIMIT 1000"
_tenant = lambda c: c.with_context(tenantId=1)
_raw = lambda c, **o: _totals(c.raw(_TOTALS, **o), c)

_rule("noDeleteManyWithoutWhere", lambda c: c.supplier.delete_many(), _then(lambda c: c.supplier.delete_many(where=_less)), f"{_SUP} WHERE NOT (s_acctbal < 0)")
_rule("noUpdateManyWithoutWhere", lambda c: c.supplier.update_many(data={"s_acctbal": 1.0}), _then(lambda c: c.supplier.update_many(where=_less, data={"s_acctbal": 0.0})), _set("s_acctbal < 0", s_acctbal="0.0"))
_rule("noDeleteWithoutWhere", lambda c: c.supplier.delete(), _then(lambda c: c.supplier.delete(where={"s_suppkey": 7})), f"{_SUP} WHERE s_suppkey <> 7")
_rule("noUpdateWithoutWhere", lambda c: c.supplier.update(data={"s_acctbal": 1.0}), _then(lambda c: c.supplier.update(where={"s_suppkey": 7}, data={"s_name": "x"})), _set("s_suppkey = 7", s_name="'x'"))
_rule("noEmptyWhere", lambda c: c.supplier.find_many(where={}), _some, _SOME)
_rule("noUnboundedFindMany", lambda c: c.supplier.find_many(), _some, _SOME, allowWithTake=True)
_rule("requireExplicitLimit", lambda c: c.supplier.find_many(where=_less), _some, _SOME)
_rule("maxLimit", lambda c: c.supplier.find_many(take=1001), _some, _SOME, value=1000)
_rule("requireOrderByForLimit", lambda c: c.supplier.find_many(take=1), _some, _SOME)
_rule("requireOrderByForPagination", lambda c: c.supplier.paginate(), lambda c: c.supplier.paginate(where=_less, orderBy=_by, limit=1000, select=_key).df, _SOME)
_rule("requireOrderByForCursor", lambda c: c.supplier.cursor(), lambda c: c.supplier.cursor(where=_less, orderBy=_by, limit=1000, select=_key).df, _SOME)
_rule("requireStableOrderByForCursor", lambda c: c.supplier.cursor(orderBy={"s_acctbal": "asc"}), lambda c: c.supplier.cursor(where=_less, orderBy=_by, limit=1000, select=_key).df, _SOME, requirePrimaryKeyInOrderBy=True)
_rule("maxIncludeDepth", lambda c: c.supplier.find_many(include={"nation": {"include": {"region": True}}}), lambda c: c.supplier.find_many(include={"nation": True}).df.select("s_suppkey", "nation.n_name"), "SELECT s_suppkey, n_name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey", value=1)
_rule("maxIncludeRelations", lambda c: c.nation.find_many(include={"customers": True, "suppliers": True}), lambda c: c.nation.find_many(include={"region": True}).df.select("n_nationkey", "region.r_name"), "SELECT n_nationkey, r_name FROM nation LEFT JOIN region ON r_regionkey = n_regionkey", value=1)
_rule("requireTransactionForLock", lambda c: c.supplier.find_many(lock="update"), _some, _SOME)
_rule("noLockWithInclude", lambda c: c.supplier.find_many(lock="update", include={"nation": True}), _some, _SOME)
_rule("noInvalidLockCombination", lambda c: c.supplier.find_many(lock={"skipLocked": True, "noWait": True}), _some, _SOME)
_rule("requireOrderByForSkipLocked", lambda c: c.supplier.find_many(lock={"skipLocked": True}), _some, _SOME)
_rule("requireLimitForSkipLocked", lambda c: c.supplier.find_many(lock={"skipLocked": True}, orderBy=_by), _some, _SOME)
_rule("noRawUnsafe", lambda c: c.raw_unsafe(_TOTALS), _raw, _TOTALS)
_rule("requireRawComment", lambda c: c.raw(_TOTALS), lambda c: _raw(c, comment="totals by status"), _TOTALS)
_rule("requireRawTimeout", lambda c: c.raw(_TOTALS), lambda c: _raw(c, timeoutMs=30000), _TOTALS)
_rule("noRawMutation", lambda c: c.execute_raw("DELETE FROM supplier"), lambda c: _totals(c.raw(_TOTALS), c).crossJoin(c.supplier.count().df), f"SELECT * FROM ({_TOTALS}), ({_COUNT})")
_rule("noRawWithoutTransaction", lambda c: c.raw(_TOTALS), lambda c: c.transaction(_raw), _TOTALS)
_rule("requireTenantContext", lambda c: c.supplier.count(), lambda c: _tenant(c).supplier.count(where=_less).df, f"{_COUNT} WHERE s_acctbal < 0")
_rule("noTenantBypassWithoutSystem", lambda c: c.supplier.count(bypassTenant=True), lambda c: c.supplier.count().df, _COUNT)
_rule("noTenantColumnOverride", lambda c: _tenant(c).supplier.create(data={"tenantId": 2}), lambda c: _tenant(c).supplier.count().df, _COUNT)
_rule("requireTenantOnCreate", lambda c: _tenant(c).supplier.create(data={"s_suppkey": 900001}), lambda c: _tenant(c).supplier.count().df, _COUNT)
_rule("requireTenantOnUpdate", lambda c: _tenant(c).supplier.update_many(data={"s_acctbal": 0.0}), _then(lambda c: _tenant(c).supplier.update_many(where=_less, data={"s_acctbal": 0.0})), _set("s_acctbal < 0", s_acctbal="0.0"))
_rule("requireTenantOnDelete", lambda c: _tenant(c).supplier.delete_many(), _then(lambda c: _tenant(c).supplier.delete_many(where=_less)), f"{_SUP} WHERE NOT (s_acctbal < 0)")
_rule("noSensitiveSelect", lambda c: c.supplier.find_many(select={"password": True}), _some, _SOME)
_rule("requireExplicitSensitiveAccessReason", lambda c: c.supplier.find_many(select={"password": True}, withSensitive=True), _some, _SOME)
_rule("noQueryDeletedWithoutExplicitOptIn", lambda c: c.supplier.find_many(deleted="with"), _some, _SOME, requireReason=True)
_rule("noHardDeleteOnSoftDeleteModel", lambda c: c.supplier.delete(where={"s_suppkey": 1}, mode="hard"), lambda c: c.supplier.count().df, _COUNT)
_rule("requireHardDeleteReason", lambda c: c.supplier.delete(where={"s_suppkey": 1}, mode="hard"), lambda c: c.supplier.count().df, _COUNT)
_rule("noSystemModeWithoutReason", lambda c: c.supplier.count(system=True), lambda c: c.supplier.count().df, _COUNT)
_rule("requireTimeoutForLongRunningOperation", lambda c: c.raw(_TOTALS), lambda c: _raw(c, timeoutMs=30000), _TOTALS)


# 2.13 validation and hooks

_ROW = {"s_suppkey": 900001, "s_name": "New", "s_nationkey": 3, "s_acctbal": 1.5}
_NEW = " UNION ALL SELECT 900001, 'New', 3, 1.5"
_checked = {"plugins": lambda: [validation()]}
_denied("validation_type", "OPERATION_ERROR", lambda c: c.supplier.create(data=_ROW | {"s_nationkey": "three"}), _then(lambda c: c.supplier.create(data=_ROW)), _SUP + _NEW, **_checked)
_denied("validation_unknown_key", "OPERATION_ERROR", lambda c: c.supplier.update(where={"s_suppkey": 7}, data={"nope": 1}), _then(lambda c: c.supplier.update(where={"s_suppkey": 7}, data={"s_name": "x"})), _set("s_suppkey = 7", s_name="'x'"), **_checked)
_denied("validation_many", "OPERATION_ERROR", lambda c: c.supplier.create_many(data=[_ROW, {"s_name": "no key"}]), _then(lambda c: c.supplier.create_many(data=[_ROW])), _SUP + _NEW, **_checked)
_denied("validation_query", "OPERATION_ERROR", lambda c: c.supplier.find_many(where={"s_name": {"like": "a"}}, validate={"query": True}), lambda c: c.supplier.find_many(where=_less, select=_key, validate={"query": True}).df, f"{_KEYS} WHERE s_acctbal < 0", **_checked)
_denied("validation_off", "done", lambda c: c.supplier.update_many(where=_less, data={"s_acctbal": 0}, validate=False), _state, _set("s_acctbal < 0", s_acctbal="0.0"), **_checked)
_denied("validation_coerce", "OPERATION_ERROR", lambda c: c.supplier.create(data=_ROW | {"s_suppkey": "x"}), _then(lambda c: c.supplier.create(data=_ROW | {"s_suppkey": "900001", "nope": 1})), _SUP + _NEW, plugins=lambda: [validation(unknown="strip", coerce=True)])


def _fails(subject: object) -> None:
    raise RuntimeError("no")


_denied("hook_replaces_data", "done", lambda c: c.supplier.create(data=_ROW | {"s_name": "raw"}), _state, _SUP + _NEW, hooks={"beforeCreate": lambda op: op.args["data"] | {"s_name": "New"}})
_denied("hook_answers_delete", "done", lambda c: c.supplier.delete_many(where=_less), _state, _SUP, hooks={"beforeDelete": lambda op: {"count": 0}})
_denied("hook_failure", "HOOK_ERROR", lambda c: c.supplier.update_many(where=_less, data={"s_acctbal": 0.0}), _state, _SUP, hooks={"beforeUpdate": _fails})
_denied("hook_transform", "done", lambda c: c.supplier.update_many(where=_less, data={"s_acctbal": 9.0}), _state, _set("s_acctbal < 0", s_acctbal="0.0"), plugins=lambda: [Plugin("zero", transform=lambda op: op.args | {"data": {"s_acctbal": 0.0}} if op.kind == "updateMany" else None)])


def _seen(c: Client) -> DataFrame:
    """The hooks and plugins that an operation met, in their order, and its result."""
    seen: list[str] = []
    note = lambda who: lambda op: seen.append(who)
    plugin = Plugin("p", hooks={"beforeQuery": note("plugin before"), "afterQuery": note("plugin after")}, transform=lambda op: seen.append("transform"))
    watched = Client.open(c.spark, c.schema, dict(c.store.frames), plugins=[plugin], hooks={"beforeQuery": note("before"), "afterQuery": note("after")})
    n = watched.supplier.count(where=_less).value()
    return c.spark.createDataFrame([(i + 1, who, n) for i, who in enumerate(seen)], "place long, met string, n long")


_denied("hook_order", "done", lambda c: None, _seen, "SELECT place, met, (SELECT count(*) FROM supplier WHERE s_acctbal < 0) AS n FROM (VALUES (1, 'plugin before'), (2, 'transform'), (3, 'before'), (4, 'after'), (5, 'plugin after')) AS t(place, met)")
_denied("plugin_duplicate", "PLUGIN_DUPLICATE_ID", lambda c: Client.open(c.spark, c.schema, {}, plugins=[Plugin("a"), Plugin("a")]), lambda c: c.supplier.count().df, _COUNT)
_denied("plugin_required_column", "PLUGIN_REQUIRED_COLUMN_MISSING", lambda c: Client.open(c.spark, c.schema, {}, plugins=[Plugin("a", requires={"columns": [{"name": "nope"}]})]), lambda c: c.supplier.count().df, _COUNT)
_denied("plugin_extends_client", "PLUGIN_EXTENSION_CONFLICT", lambda c: c.extends(lambda x: {"supplier": 1}), lambda c: c.extends(lambda x: {"poor": lambda: x.supplier.find_many(where=_less, select=_key).df}).poor(), f"{_KEYS} WHERE s_acctbal < 0")


# 2.2, 2.5, 2.7 to 2.11: errors, limits and switches

_denied("unknown_column", "OPERATION_ERROR", lambda c: c.supplier.find_many(where={"nope": 1}), lambda c: c.supplier.find_many(where=_less, select=_key).df, f"{_KEYS} WHERE s_acctbal < 0")
_denied("lenient_column", "done", lambda c: c.supplier.find_many(where={"nope": 1}), lambda c: c.supplier.find_many(where={"nope": 1, **_less}, select=_key).df, f"{_KEYS} WHERE s_acctbal < 0", lenient=True)
_denied("where_unset", "done", lambda c: None, lambda c: c.supplier.find_many(where={"s_name": UNSET, **_less}, select=_key).df, f"{_KEYS} WHERE s_acctbal < 0")
_denied("where_plain_object", "OPERATION_ERROR", lambda c: c.supplier.find_many(where={"s_name": {"a": 1}}), lambda c: c.supplier.find_many(where={}, select=_key).df, _KEYS)
_denied("where_escaped_pattern", "done", lambda c: None, lambda c: c.supplier.find_many(where={"NOT": {"s_name": {"contains": "%"}}}, select=_key).df, f"{_KEYS} WHERE NOT contains(s_name, '%')", escape_like=True)
_denied("select_with_include", "OPERATION_ERROR", lambda c: c.supplier.find_many(select=_key, include={"nation": True}), lambda c: c.supplier.find_many(select=_key).df, _KEYS)
_denied("nested_lock", "LOCK_NOT_SUPPORTED", lambda c: c.nation.find_many(include={"suppliers": {"lock": "update"}}), lambda c: c.supplier.count().df, _COUNT)
_denied("lock_outside", "LOCK_REQUIRES_TRANSACTION", lambda c: c.supplier.find_many(lock="update"), lambda c: c.supplier.count().df, _COUNT)
_denied("lock_refused", "LOCK_NOT_SUPPORTED", lambda c: c.transaction(lambda tx: tx.supplier.find_many(lock={"mode": "share"})), lambda c: c.supplier.count().df, _COUNT)
_denied("cursor_both_ways", "OPERATION_ERROR", lambda c: c.supplier.cursor(cursor={"after": {"s_suppkey": 1}, "before": {"s_suppkey": 9}}), lambda c: c.supplier.count().df, _COUNT)
_denied("or_throw", "RESULT_NOT_FOUND", lambda c: c.supplier.find_unique(where={"s_suppkey": -1}).or_throw(), lambda c: c.supplier.find_many(where={"s_suppkey": c.supplier.find_unique(where={"s_suppkey": 7}).or_throw()["s_suppkey"]}).df, f"{_SUP} WHERE s_suppkey = 7")
_denied("repository", "REPOSITORY_NOT_FOUND", lambda c: c.repository("nope"), lambda c: c.repository("supplier").find_many(select=_key).df, _KEYS)
_denied("unique_violation", "unique", lambda c: c.supplier.create(data=_ROW | {"s_suppkey": 1}), _state, _SUP)
_denied("not_null_violation", "notNull", lambda c: c.supplier.update_many(where={"s_suppkey": {"lt": 5}}, data={"s_suppkey": None}), _state, _SUP)
_denied("relation_selector", "OPERATION_ERROR", lambda c: c.supplier.update(where={"s_suppkey": 7}, data={"nation": {"connect": {"n_regionkey": 1}}}), lambda c: (c.supplier.update(where={"s_suppkey": 7}, data={"nation": {"connect": {"n_nationkey": 4}}}), _state(c))[1], _set("s_suppkey = 7", s_nationkey="4"))
_denied("relation_commands", "OPERATION_ERROR", lambda c: c.supplier.create(data=_ROW | {"nation": {"disconnect": True}}), _state, _SUP)


def _fails_late(tx: Client) -> None:
    tx.supplier.update_many(where=_less, data={"s_acctbal": 0.0})
    tx.supplier.create(data={"s_suppkey": 1})


_denied("implicit_transaction", "unique", lambda c: c.transaction(_fails_late), _state, _SUP)
_denied("transaction_timeout", "TRANSACTION_TIMEOUT", lambda c: c.transaction(lambda tx: [tx.supplier.update_many(where=_less, data={"s_acctbal": 0.0}) for _ in range(50)], timeoutMs=1), _state, _SUP)
_denied("transaction_option", "TRANSACTION_UNSUPPORTED_OPTION", lambda c: c.transaction(lambda tx: None, isolationLevel="serializable", unsupportedOptions="throw"), lambda c: c.supplier.count().df, _COUNT)
_denied("after_commit_outside", "AFTER_COMMIT_OUTSIDE_TRANSACTION", lambda c: c.after_commit(lambda: None), lambda c: c.supplier.count().df, _COUNT)


def _calls(c: Client) -> DataFrame:
    """The callbacks that a committed and a rolled back transaction made."""
    made: list[str] = []

    def work(tx: Client) -> None:
        tx.after_commit(lambda: made.append("committed"))
        tx.after_rollback(lambda: made.append("rolled back"))
        if tx.meta.get("fail"):
            tx.rollback()

    c.transaction(work)
    outcome(lambda: c.transaction(work, context={"fail": True}))
    return c.spark.createDataFrame([(i + 1, x) for i, x in enumerate(made)], "place long, made string")


_denied("transaction_callbacks", "done", lambda c: None, _calls, "SELECT * FROM (VALUES (1, 'committed'), (2, 'rolled back')) AS t(place, made)")


def _retried(c: Client) -> DataFrame:
    """A transaction that another writer overtakes once."""
    tries: list[int] = []

    def work(tx: Client) -> None:
        tx.supplier.update_many(where=_less, data={"s_acctbal": 0.0})
        tries.append(1)
        if len(tries) == 1:
            c.supplier.update(where={"s_suppkey": 7}, data={"s_name": "first"})

    c.transaction(work, retry={"attempts": 3})
    return _state(c).withColumn("tries", F.lit(len(tries)))


_denied("transaction_retry", "DATABASE_ERROR", lambda c: c.transaction(lambda tx: [tx.supplier.create(data=_ROW), c.supplier.update(where={"s_suppkey": 8}, data={"s_name": "eight"})]), _retried, "SELECT s_suppkey, CASE s_suppkey WHEN 7 THEN 'first' WHEN 8 THEN 'eight' ELSE s_name END AS s_name, s_nationkey, CASE WHEN s_acctbal < 0 THEN 0.0 ELSE s_acctbal END AS s_acctbal, 2 AS tries FROM supplier")

_denied("raw_unsafe", "RAW_UNSAFE_PLACEHOLDER_MISMATCH", lambda c: c.raw_unsafe("SELECT ?"), lambda c: _totals(c.raw_unsafe("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > ? AND o_orderstatus <> '?' GROUP BY 1", [100000.0]), c), "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY 1", raw={"allowUnsafe": True})
_denied("raw_unsafe_off", "RAW_UNSAFE_DISABLED", lambda c: c.raw_unsafe(_TOTALS), _raw, _TOTALS)
_denied("raw_off", "RAW_DISABLED", lambda c: c.raw(_TOTALS), lambda c: c.supplier.count().df, _COUNT, raw={"enabled": False})
_denied("raw_comment", "RAW_COMMENT_REQUIRED", lambda c: c.raw(_TOTALS), lambda c: _raw(c, comment="why */ not"), _TOTALS, raw={"requireComment": True})
_denied("raw_invalid", "RAW_INVALID_QUERY", lambda c: c.execute_raw("DROP TABLE supplier"), _state, _SUP)
_denied("raw_timeout", "RAW_TIMEOUT", lambda c: c.raw("SELECT count(*) AS n FROM range(100000000000) WHERE hash(id) = 7", timeoutMs=300), _raw, _TOTALS)


# 2.12 explain


def _explained(c: Client) -> DataFrame:
    """By statement of a page: whether there is a plan, whether the filter is pushed down, and its rows."""
    out = c.orders.paginate(where={"o_orderstatus": "F"}, orderBy={"o_orderkey": "asc"}, limit=20).explain(analyze=True)
    rows = [(k, "Scan parquet" in s["plan"], "EqualTo(o_orderstatus,F)" in s["plan"], s["rows"]) for k, s in out["statements"].items()]
    return c.spark.createDataFrame(rows, "statement string, plan boolean, pushed boolean, n long")


_denied("explain", "OPERATION_ERROR", lambda c: c.orders.count().explain(nope=True), _explained, "SELECT 'data' AS statement, TRUE AS plan, TRUE AS pushed, least(20, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F')) AS n UNION ALL SELECT 'total', TRUE, TRUE, 1")

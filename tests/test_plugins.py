from __future__ import annotations

from datetime import datetime
from decimal import Decimal

import pytest
from blog import blog

from graphlake import Column, EngineError, ErrorCode, Schema, Table, domain, guard_queries
from graphlake.client import Client
from graphlake.errors import is_check_violation, is_foreign_key_violation, is_unique_violation
from graphlake.hooks import HOOKS, Plugin
from graphlake.plugins import rules, soft_delete, timestamps, validation
from graphlake.plugins.rules import RULES, merge_rules, recommended, safe, strict

AT = datetime(2024, 5, 1)


def test_hook_order_and_replacement(spark):
    seen = []
    note = lambda who: lambda op: seen.append(who)
    plugin = Plugin("p", hooks={"beforeQuery": note("plugin before"), "afterQuery": note("plugin after")}, transform=lambda op: seen.append("transform"))
    db = blog(spark, plugins=[plugin], hooks={"beforeQuery": note("before"), "afterQuery": note("after")})
    db.users.count().value()
    assert seen == ["plugin before", "transform", "before", "after", "plugin after"]
    db = blog(spark, hooks={"beforeCreate": lambda op: {**op.args["data"], "name": "Hooked"}, "beforeDelete": lambda op: {"id": -1}, "beforeQuery": lambda op: 42 if op.kind == "count" else None})
    assert db.users.create(data={"id": 6, "email": "z", "name": "Z", "age": 1, "active": True})["name"] == "Hooked"
    assert db.users.delete(where={"id": 1}) == {"id": -1}
    assert db.users.count() == 42
    assert len(HOOKS) == 16


def test_hook_errors_are_reported_once(spark):
    errors = []

    def boom(op):
        raise RuntimeError("boom")

    db = blog(spark, hooks={"beforeQuery": boom, "onError": lambda e, op: errors.append((e.code, e.details["stage"]))})
    with pytest.raises(EngineError) as e:
        db.users.find_many()
    assert e.value.code == ErrorCode.HOOK_ERROR and errors == [(ErrorCode.HOOK_ERROR, "beforeQuery")]
    with pytest.raises(EngineError):
        blog(spark, hooks={"nope": boom})


def test_transaction_hooks(spark):
    seen = []
    db = blog(spark, hooks={"beforeTransaction": lambda c: seen.append("begin"), "afterTransactionCommit": lambda c: seen.append("commit"), "afterTransactionRollback": lambda c: seen.append("rollback"), "onTransactionError": lambda e, c: seen.append(e.code)})
    db.transaction(lambda tx: None)
    with pytest.raises(EngineError):
        db.transaction(lambda tx: tx.rollback())
    with pytest.raises(ValueError):
        db.transaction(lambda tx: int("x"))
    assert seen == ["begin", "commit", "begin", "rollback", "begin", "rollback", ErrorCode.UNKNOWN]


@pytest.mark.parametrize(
    ("plugins", "code"),
    [
        ([Plugin("a"), Plugin("a")], ErrorCode.PLUGIN_DUPLICATE_ID),
        ([Plugin("a", dialects=("mysql",))], ErrorCode.PLUGIN_DIALECT_UNSUPPORTED),
        ([Plugin("a", requires={"columns": [{"name": "nope"}]})], ErrorCode.PLUGIN_REQUIRED_COLUMN_MISSING),
        ([Plugin("a", operation_args={"count": ("x",)}), Plugin("b", operation_args={"count": ("x",)})], ErrorCode.PLUGIN_OPERATION_ARG_CONFLICT),
        ([Plugin("a", extend_client=lambda c: {"users": 1})], ErrorCode.PLUGIN_EXTENSION_CONFLICT),
    ],
)
def test_plugin_checks(spark, plugins, code):
    with pytest.raises(EngineError) as e:
        blog(spark, plugins=plugins)
    assert e.value.code == code


def test_extensions_and_context(spark):
    metas = []
    db = blog(spark, context={"a": 1}, plugins=[Plugin("m", requires={"columns": [{"name": "nope", "optional": True}]}, extend_model=lambda c, t: {"total": lambda: c[t.name].count().value()})], hooks={"beforeQuery": lambda op: metas.append(op.meta)})
    more = db.extends(lambda c: {"everybody": lambda: c.users.find_many(select={"id": True}).value()})
    assert db.users.total() == 5 and len(more.with_context(b=2).everybody()) == 5
    assert more.transaction(lambda tx: len(tx.everybody())) == 5
    db.with_context(b=2).users.count(meta={"a": 3}).value()
    assert metas[-1] == {"a": 3, "b": 2}
    with pytest.raises(AttributeError):
        db.nope


def notes(spark, *plugins, extra=()):
    cols = {"id": Column("int", nullable=False), "name": Column("string"), "deletedAt": Column("timestamp_ntz"), "deletedById": Column("string"), "createdAt": Column("timestamp_ntz"), "updatedAt": Column("timestamp_ntz")}
    s = Schema({"notes": Table(cols, ("id",)), "plain": Table({"id": Column("int", nullable=False), "name": Column("string")}, ("id",))})
    rows = spark.createDataFrame([(1, "a", None, None, None, None), (2, "b", AT, "x", None, None), (3, "c", None, None, None, None)], "id int, name string, deletedAt timestamp_ntz, deletedById string, createdAt timestamp_ntz, updatedAt timestamp_ntz")
    return Client.open(spark, s, {"notes": rows, "plain": spark.createDataFrame([(1, "a")], "id int, name string")}, plugins=list(plugins))


def test_soft_delete(spark):
    db = notes(spark, soft_delete(clock=lambda: AT))
    ids = lambda **a: {r["id"] for r in db.notes.find_many(**a).value()}
    assert ids() == {1, 3} and ids(deleted="only") == {2} and ids(deleted="with") == {1, 2, 3}
    assert db.notes.count().value() == 2 and db.notes.exists(where={"id": 2}).value() is False
    assert db.notes.find_unique(where={"id": 2}).value() is not None  # not covered unless strict
    gone = db.notes.delete(where={"id": 1}, deletedBy="me")
    assert gone["deletedAt"] == AT and gone["deletedById"] == "me" and ids() == {3}
    assert db.notes.restore({"id": 1}) == {"count": 1} and ids() == {1, 3}
    assert db.notes.restore_by_id(2)["deletedAt"] is None
    db.notes.delete(where={"id": 3}, mode="hard")
    assert ids(deleted="with") == {1, 2}
    db.plain.delete(where={"id": 1})
    assert db.plain.count().value() == 0 and not hasattr(db.plain, "restore")
    hard = notes(spark, soft_delete(strict=True, clock=lambda: AT))
    assert hard.notes.find_unique(where={"id": 2}).value() is None
    assert hard.notes.paginate().value()["pagination"]["total"] == 2
    assert hard.notes.delete_many(where={"id": {"gt": 0}}) == {"count": 2} and hard.notes.count(deleted="with").value() == 3


def test_timestamps(spark):
    now = [AT]
    db = notes(spark, timestamps(clock=lambda: now[0]))
    row = db.notes.create(data={"id": 9, "name": "n"})
    assert row["createdAt"] == row["updatedAt"] == AT
    assert db.notes.create(data={"id": 10, "createdAt": datetime(2000, 1, 1)})["createdAt"] == datetime(2000, 1, 1)
    now[0] = datetime(2025, 1, 1)
    assert db.notes.update(where={"id": 9}, data={"name": "m"})["updatedAt"] == now[0]
    db.notes.upsert_many(data=[{"id": 9, "name": "u"}, {"id": 11, "name": "v"}], target="id")
    rows = {r["id"]: r for r in db.notes.find_many().value()}
    assert rows[9]["createdAt"] == AT and rows[9]["name"] == "u" and rows[11]["createdAt"] == now[0]
    db.notes.update_each(by="id", data=[{"id": 1, "name": "e"}])
    assert db.notes.find_unique(where={"id": 1}).value()["updatedAt"] == now[0]
    assert db.plain.create(data={"id": 2}) == {"id": 2, "name": None}
    assert notes(spark, timestamps(mode="database")).notes.create(data={"id": 9})["createdAt"] is None


def test_validation(spark):
    cols = {"id": Column("int", nullable=False), "kind": Column("string", enum=("a", "b")), "price": Column("decimal(10,2)"), "n": Column("bigint", generated=True)}
    s = Schema({"t": Table(cols, ("id",))})
    rows = spark.createDataFrame([(1, "a", Decimal("1.50"), 5)], "id int, kind string, price decimal(10,2), n bigint")
    db = Client.open(spark, s, {"t": rows}, plugins=[validation()])
    assert db.t.create(data={"id": 2, "kind": "b", "price": "2.25"})["price"] == Decimal("2.25")
    for bad in ({"kind": "a"}, {"id": "3"}, {"id": 3, "kind": "z"}, {"id": 3, "price": 1.5}, {"id": 3, "x": 1}, {"id": 1 << 40}, {"id": None}, {"id": True}, {"id": 3, "n": 1}):
        with pytest.raises(EngineError) as e:
            db.t.create(data=bad)
        assert e.value.status == 422
    assert db.t.find_many(where={"kind": {"in": ["a"]}}).value()[0]["id"] == 1
    with pytest.raises(EngineError):
        db.t.find_many(where={"kind": {"like": "a"}}, validate={"query": True})
    lax = Client.open(spark, s, {"t": rows}, plugins=[validation(unknown="strip", coerce=True, fields={"kind": lambda v: v.lower()})])
    assert lax.t.create(data={"id": "7", "kind": "A", "x": 1})["kind"] == "a"
    assert lax.t.update(where={"id": 7}, data={"price": 3})["price"] == Decimal("3.00")


@pytest.mark.parametrize(
    ("config", "call"),
    [
        ("noDeleteManyWithoutWhere", lambda d: d.users.delete_many()),
        ("noUpdateManyWithoutWhere", lambda d: d.users.update_many(data={"age": 1})),
        ("noDeleteWithoutWhere", lambda d: d.users.delete()),
        ("noUpdateWithoutWhere", lambda d: d.users.update(data={"age": 1})),
        ("noEmptyWhere", lambda d: d.users.find_many(where={})),
        ("noUnboundedFindMany", lambda d: d.users.find_many()),
        ("requireExplicitLimit", lambda d: d.users.find_many()),
        ({"maxLimit": {"value": 10}}, lambda d: d.users.find_many(take=11)),
        ("requireOrderByForLimit", lambda d: d.users.find_many(take=1)),
        ("requireOrderByForPagination", lambda d: d.users.paginate()),
        ("requireOrderByForCursor", lambda d: d.users.cursor()),
        ({"requireStableOrderByForCursor": {"requirePrimaryKeyInOrderBy": True}}, lambda d: d.users.cursor(orderBy={"age": "asc"})),
        ({"maxIncludeDepth": {"value": 1}}, lambda d: d.users.find_many(include={"posts": {"include": {"comments": True}}})),
        ({"maxIncludeRelations": {"value": 1}}, lambda d: d.users.find_many(include={"posts": True, "comments": True})),
        ("requireTransactionForLock", lambda d: d.users.find_many(lock="update")),
        ("noLockWithInclude", lambda d: d.users.find_many(lock="update", include={"posts": True})),
        ("noInvalidLockCombination", lambda d: d.users.find_many(lock={"skipLocked": True, "noWait": True})),
        ("requireOrderByForSkipLocked", lambda d: d.users.find_many(lock={"skipLocked": True})),
        ("requireLimitForSkipLocked", lambda d: d.users.find_many(lock={"skipLocked": True}, orderBy={"id": "asc"})),
        ("noRawUnsafe", lambda d: d.raw_unsafe("SELECT 1")),
        ("requireRawComment", lambda d: d.raw("SELECT 1")),
        ("requireRawTimeout", lambda d: d.raw("SELECT 1")),
        ("noRawMutation", lambda d: d.execute_raw("/* x */ DELETE FROM users")),
        ("noRawWithoutTransaction", lambda d: d.raw("SELECT 1")),
        ("requireTenantContext", lambda d: d.users.count()),
        ("noTenantBypassWithoutSystem", lambda d: d.users.count(bypassTenant=True)),
        ("noTenantColumnOverride", lambda d: d.with_context(tenantId=1).users.create(data={"tenantId": 2})),
        ("requireTenantOnCreate", lambda d: d.with_context(tenantId=1).users.create(data={"id": 2})),
        ("requireTenantOnUpdate", lambda d: d.with_context(tenantId=1).users.update_many(data={"id": 2})),
        ("requireTenantOnDelete", lambda d: d.with_context(tenantId=1).users.delete_many()),
        ("noSensitiveSelect", lambda d: d.users.find_many(select={"password": True})),
        ("requireExplicitSensitiveAccessReason", lambda d: d.users.find_many(select={"password": True}, withSensitive=True)),
        ({"noQueryDeletedWithoutExplicitOptIn": {"requireReason": True}}, lambda d: d.users.find_many(deleted="with")),
        ("noHardDeleteOnSoftDeleteModel", lambda d: d.users.delete(where={"id": 1}, mode="hard")),
        ("requireHardDeleteReason", lambda d: d.users.delete(where={"id": 1}, mode="hard")),
        ("noSystemModeWithoutReason", lambda d: d.users.count(system=True)),
        ("requireTimeoutForLongRunningOperation", lambda d: d.raw("SELECT 1")),
    ],
)
def test_each_rule(spark, config, call):
    name = config if isinstance(config, str) else next(iter(config))
    options = {config: True} if isinstance(config, str) else {name: {"level": "error", **config[name]}}
    with pytest.raises(EngineError) as e:
        call(blog(spark, plugins=[rules(options)], raw={"allowUnsafe": True}))
    assert e.value.details["rule"] == name
    seen = []
    options = {name: {**(options[name] if isinstance(options[name], dict) else {}), "level": "warn"}}
    try:
        with pytest.warns(UserWarning, match=name):
            call(blog(spark, plugins=[rules(options, on_violation=seen.append)], raw={"allowUnsafe": True}))
    except EngineError as error:
        assert error.details.get("rule") is None
    assert seen and seen[0].level == "warn"


def test_rule_configuration(spark):
    assert len(RULES) == 37
    assert set(safe()) <= set(recommended()) <= set(strict())
    assert strict({"maxLimit": "off"})["maxLimit"] == "off" and merge_rules({"a": {"x": 1}}, None, {"a": {"y": 2}}) == {"a": {"y": 2}}
    scoped = blog(spark, plugins=[rules({"noUnboundedFindMany": {"ignoreModels": ["users"]}, "requireAuditContext": True})])
    assert len(scoped.users.find_many().value()) == 5
    with pytest.raises(EngineError):
        scoped.posts.find_many()
    assert len(blog(spark, plugins=[rules({"noUnboundedFindMany": True})]).without_plugins().posts.find_many().value()) == 6
    with pytest.raises(EngineError):
        rules({"nope": True})


def test_errors():
    class Db(Exception):
        sqlstate = "23505"

    assert len(ErrorCode) == 34
    e = EngineError.of(Db("x"), ErrorCode.DATABASE_ERROR)
    assert is_unique_violation(e) and not is_foreign_key_violation(e) and not is_check_violation(e)
    assert e.with_details(a=1).to_json()["details"] == {"a": 1} and e.to_json()["cause"] == {"name": "Db", "message": "x"}
    assert EngineError.of(e) is e and e.with_cause(ValueError("y")).cause.args == ("y",)
    assert is_foreign_key_violation(Exception("FOREIGN KEY constraint failed")) and is_check_violation(Exception("CHECK constraint failed"))


@pytest.mark.parametrize("name", ["requireOrderByForCursor", "requireStableOrderByForCursor"])
def test_rule_rows_beyond_a_page(spark, monkeypatch, name):
    """More rows than the page of 1,000 takes: the query ends where its SQL does."""
    suppliers = spark.range(1100).selectExpr("id AS s_suppkey", "'s' AS s_name", "1 AS s_nationkey", "IF(id % 100 = 0, 1.0D, -1.0D) AS s_acctbal")
    monkeypatch.setattr(guard_queries, "client", lambda spark, sf_dir, **options: Client.open(spark, domain.schema(), {"supplier": suppliers}, **options))
    suppliers.createOrReplaceTempView("supplier")
    try:
        expected = spark.sql(guard_queries.ORACLES[f"rule_{name}"]).collect()
    finally:
        spark.catalog.dropTempView("supplier")
    rows = guard_queries.QUERIES[f"rule_{name}"](spark, "").collect()
    assert len(expected) == 1000 and rows == expected

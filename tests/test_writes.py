from __future__ import annotations

import threading
from datetime import datetime

import pytest
from blog import blog

from graphlake import Column, EngineError, ErrorCode, Schema, Table
from graphlake.client import Client
from graphlake.errors import is_not_null_violation, is_unique_violation
from graphlake.schema import many, one

ZOE = {"id": 6, "email": "zoe@example.com", "name": "Zoe", "age": 40, "active": True}


@pytest.fixture
def db(spark):
    return blog(spark)


def test_create(db):
    assert db.users.create(data=ZOE) == ZOE
    assert db.users.count().value() == 6
    with pytest.raises(EngineError) as e:
        db.users.create(data=ZOE | {"id": 7})
    assert is_unique_violation(e.value) and e.value.code == ErrorCode.DATABASE_ERROR
    with pytest.raises(EngineError) as e:
        db.users.create(data={"id": 8, "email": "x"})
    assert is_not_null_violation(e.value)
    assert db.users.create(data=ZOE, skipDuplicates=True) is None
    with pytest.raises(EngineError):
        db.users.create(data=ZOE | {"id": 9}, skipDuplicates=["id"])
    with pytest.raises(EngineError):
        db.users.create(data=ZOE, skipDuplicates=["nope"])
    assert db.users.create(data=ZOE | {"id": 10, "email": "y"}, select={"name": True}) == {"name": "Zoe"}


def test_create_many(db):
    assert db.users.create_many(data=[]) == {"count": 0}
    out = db.users.create_many(data=[ZOE, ZOE | {"name": "Second"}, ZOE | {"id": 1}], skipDuplicates=True, select={"id": True, "name": True})
    assert out == {"count": 1, "data": [{"id": 6, "name": "Zoe"}]}
    with pytest.raises(EngineError):
        db.users.create_many(data=[ZOE | {"id": 7, "email": "a"}, ZOE | {"id": 7, "email": "b"}])
    assert db.users.count().value() == 6


def test_update_and_delete(db):
    assert db.users.update(where={"id": 1}, data={"age": 26}, select={"age": True}) == {"age": 26}
    assert db.users.update(where={}, data={"age": 1}) is None and db.users.update(data={"age": 1}) is None
    assert db.users.update(where={"active": True}, data={"age": 50})["id"] == 1
    assert db.users.count(where={"age": 50}).value() == 3
    assert db.users.update_many(data={"age": 1}) == {"count": 0}
    assert db.users.update_many(where={"posts": {"none": {}}}, data={"age": 99}) == {"count": 1}
    with pytest.raises(EngineError):
        db.users.update(where={"id": 1}, data={"email": "bob@example.com"})
    assert db.posts.delete(where={"id": 6}, include={"author": True})["author"]["name"] == "Diana"
    assert db.posts.delete(where={"id": 99}) is None
    assert db.posts.delete_many() == {"count": 0}
    assert db.posts.delete_many(where={"published": False}) == {"count": 2}
    assert [r["id"] for r in db.posts.find_many(orderBy={"id": "asc"}).value()] == [1, 3, 4]


def test_update_each(db):
    rows = [{"id": 1, "age": 1}, {"id": 2, "name": "B", "age": 2}, {"id": 77, "age": 3}]
    out = db.users.update_each(by="id", data=rows, select={"id": True, "name": True, "age": True})
    assert out["count"] == 2 and sorted(out["data"], key=lambda r: r["id"]) == [{"id": 1, "name": "Alice", "age": 1}, {"id": 2, "name": "B", "age": 2}]
    assert db.users.update_each(by="id", data=rows[:2], update=["age"], where={"active": False}) == {"count": 0}
    assert db.users.update_each(by="id", data=[{"id": 3}], update=lambda r: {"age": r["id"] * 10}) == {"count": 1}
    assert db.users.find_unique(where={"id": 3}).value()["age"] == 30
    assert db.users.update_each(by="id", data=[]) == {"count": 0}
    for bad in ({"data": [], "onEmpty": "throw"}, {"data": [{"id": 1, "age": 1}] * 2}, {"data": [{"age": 1}]}, {"data": [{"id": 1}]}, {"data": [{"id": 1}], "update": lambda r: None}):
        with pytest.raises(EngineError):
            db.users.update_each(by="id", **bad)


def test_upserts(db):
    assert db.users.upsert(where={"id": 6}, create=ZOE, update={"age": 1})["age"] == 40
    assert db.users.upsert(where={"id": 6}, create=ZOE, update={"age": 41})["age"] == 41
    rows = [{"id": 9, "userId": 1, "label": "owner", "note": "new"}, {"id": 10, "userId": 5, "label": "guest", "note": "n"}]
    out = db.memberships.upsert_many(data=rows, target=["userId", "label"], update=["note"], select={"id": True, "note": True})
    assert out["count"] == 2 and {r["id"]: r["note"] for r in out["data"]} == {1: "new", 10: "n"}
    assert db.memberships.upsert_many(data=rows, target=["userId", "label"], update=["note"], where={"note": "other"}) == {"count": 0}
    for bad in ({"batchSize": 0}, {"target": "nope"}, {"update": ["nope"]}, {"update": {}}, {"data": rows[:1] * 2}):
        with pytest.raises(EngineError):
            db.memberships.upsert_many(**({"data": rows, "target": ["userId", "label"], "update": "all"} | bad))


def test_relation_writes(db):
    post = db.posts.create(data={"id": 7, "title": "t", "body": "b", "score": 1, "published": True, "author": {"connect": {"email": "eve@example.com"}}}, include={"author": True})
    assert post["author"]["name"] == "Eve"
    db.users.update(where={"id": 5}, data={"posts": {"connect": [{"id": 1}, {"id": 2}]}})
    assert db.posts.count(where={"userId": 5}).value() == 3
    with pytest.raises(EngineError):  # the key is not nullable
        db.users.update(where={"id": 5}, data={"posts": {"set": []}})
    assert db.posts.count(where={"userId": 5}).value() == 3
    for bad in ({"author": {"disconnect": True}}, {"author": {"connect": {"name": "Nobody"}}}, {"author": {"connect": {}}}, {"author": {"set": {"id": 1}, "connect": {"id": 1}}}, {"author": {"nope": 1}}):
        with pytest.raises(EngineError):
            db.posts.update(where={"id": 1}, data=bad)
    with pytest.raises(EngineError):
        db.posts.update(where={"published": True}, data={"author": {"connect": {"id": 1}}})


@pytest.fixture(scope="module")
def club_schema():
    c = lambda t, **k: Column(t, **k)
    return Schema(
        {
            "users": Table({"id": c("int", nullable=False), "name": c("string")}, ("id",)),
            "groups": Table({"id": c("int", nullable=False), "name": c("string")}, ("id",)),
            "userGroups": Table({"userId": c("int", nullable=False), "groupId": c("int", nullable=False)}, ("userId", "groupId")),
            "profiles": Table({"id": c("int", nullable=False), "userId": c("int"), "bio": c("string")}, ("id",), (("userId",),)),
        },
        {
            "users": {"profile": one("profiles", "id", "userId", owning=False)},
            "userGroups": {"user": one("users", "userId", "id"), "group": one("groups", "groupId", "id")},
            "profiles": {"user": one("users", "userId", "id")},
        },
    )


def club(spark, s):
    f = spark.createDataFrame
    return Client.open(spark, s, {"users": f([(1, "a"), (2, "b"), (3, "c")], "id int, name string"), "groups": f([(1, "g1"), (2, "g2")], "id int, name string"), "userGroups": f([(1, 1), (1, 2), (2, 1)], "userId int, groupId int"), "profiles": f([(1, 1, "x"), (2, None, "y")], "id int, userId int, bio string")})


def test_inferred_many_to_many(spark, club_schema):
    db = club(spark, club_schema)
    shown = lambda: {u["id"]: [g["id"] for g in u["groups"]] for u in db.users.find_many(include={"groups": {"orderBy": {"id": "asc"}}}).value()}
    assert shown() == {1: [1, 2], 2: [1], 3: []}
    assert {u["id"] for u in db.users.find_many(where={"groups": {"some": {"name": "g2"}}}).value()} == {1}
    assert {u["id"] for u in db.users.find_many(where={"groups": {"none": {}}}).value()} == {3}
    db.users.update(where={"id": 3}, data={"groups": {"connect": [{"id": 1}, {"name": "g2"}]}})
    db.users.update(where={"id": 3}, data={"groups": {"connect": {"id": 1}}})
    db.users.update(where={"id": 1}, data={"groups": {"disconnect": {"id": 1}}})
    db.users.update(where={"id": 2}, data={"groups": {"set": [{"id": 2}]}})
    assert shown() == {1: [2], 2: [2], 3: [1, 2]}
    assert db.groups.find_first(where={"id": 2}, include={"_count": {"select": {"users": True}}}).value()["_count"] == {"users": 3}


def test_reverse_one(spark, club_schema):
    db = club(spark, club_schema)
    db.users.update(where={"id": 2}, data={"profile": {"connect": {"id": 2}}})
    assert {u["id"]: u["profile"] and u["profile"]["bio"] for u in db.users.find_many(include={"profile": True}).value()} == {1: "x", 2: "y", 3: None}
    db.users.update(where={"id": 1}, data={"profile": {"set": {"id": 2}}})
    assert {p["id"]: p["userId"] for p in db.profiles.find_many().value()} == {1: None, 2: 1}
    db.users.update(where={"id": 1}, data={"profile": {"disconnect": True}})
    assert db.profiles.count(where={"userId": None}).value() == 2


def test_ambiguous_and_explicit_many_to_many():
    def tables():
        t = {n: Table({"id": Column("int", nullable=False)}, ("id",)) for n in ("a", "b")}
        return t | {n: Table({"aId": Column("int", nullable=False), "bId": Column("int", nullable=False)}, ("aId", "bId")) for n in ("ab", "ba")}

    links = {n: {"a": one("a", "aId", "id"), "b": one("b", "bId", "id")} for n in ("ab", "ba")}
    s = Schema(tables(), links)
    with pytest.raises(EngineError, match="ambiguous"):
        s.relation(s.tables["a"], "b")
    s = Schema(tables(), links, [{"through": "ab", "left": {"relation": "a", "name": "bs"}, "right": {"relation": "b"}}])
    assert s.relation(s.tables["a"], "bs").through == "ab" and s.relation(s.tables["b"], "a").through == "ab"
    with pytest.raises(EngineError, match="ambiguous"):
        s.relation(s.tables["a"], "b")
    assert "b" not in Schema(tables(), links, infer_many_to_many=False).tables["a"].relations
    with pytest.raises(EngineError):
        Schema(tables(), links, [{"through": "ab", "left": {"relation": "nope"}, "right": {"relation": "b"}}])


def test_transactions(db):
    calls = []

    def work(tx):
        tx.users.create(data=ZOE)
        tx.after_commit(lambda: calls.append("commit"))
        tx.after_rollback(lambda: calls.append("rollback"))
        assert tx.users.count().value() == 6 and db.users.count().value() == 5

        def inner(sp):
            sp.users.delete_many(where={"id": {"gt": 0}})
            assert sp.users.count().value() == 0
            sp.rollback("inner")

        with pytest.raises(EngineError) as e:
            tx.transaction(inner)
        assert e.value.code == ErrorCode.TRANSACTION_ROLLBACK and e.value.status == 409
        return tx.users.count().value()

    assert db.transaction(work) == 6 and db.users.count().value() == 6 and calls == ["commit"]

    def failing(tx):
        tx.users.delete(where={"id": 1})
        tx.after_commit(lambda: calls.append("never"))
        tx.after_rollback(lambda: calls.append("rolled"))
        raise ValueError("x")

    with pytest.raises(ValueError):
        db.transaction(failing)
    assert db.users.count().value() == 6 and calls == ["commit", "rolled"]
    for fn in (db.after_commit, db.after_rollback):
        with pytest.raises(EngineError):
            fn(lambda: None)


def test_transaction_conflicts_retry(db):
    attempts = []

    def work(tx):
        attempts.append(1)
        tx.users.update(where={"id": 1}, data={"age": 99})
        if len(attempts) == 1:
            db.users.update(where={"id": 2}, data={"age": 98})  # another commit to the same table

    with pytest.raises(EngineError, match="serialize"):
        db.transaction(work)
    attempts.clear()
    db.transaction(work, retry={"attempts": 3, "on": ["serializationFailure"], "delayMs": lambda n: 1})
    assert len(attempts) == 2 and db.users.count(where={"age": {"gte": 98}}).value() == 2


def test_transaction_limits(db):
    import time

    with pytest.raises(EngineError) as e:
        db.transaction(lambda tx: time.sleep(0.05), timeoutMs=10)
    assert e.value.code == ErrorCode.TRANSACTION_TIMEOUT
    signal = threading.Event()
    signal.set()
    with pytest.raises(EngineError) as e:
        db.transaction(lambda tx: None, signal=signal)
    assert e.value.code == ErrorCode.TRANSACTION_ABORTED
    with pytest.warns(UserWarning):
        db.transaction(lambda tx: None, isolationLevel="serializable")
    with pytest.raises(EngineError) as e:
        db.transaction(lambda tx: None, readOnly=True, unsupportedOptions="throw")
    assert e.value.code == ErrorCode.TRANSACTION_UNSUPPORTED_OPTION


def test_locks(db):
    with pytest.raises(EngineError) as e:
        db.users.find_many(lock="update")
    assert e.value.code == ErrorCode.LOCK_REQUIRES_TRANSACTION
    with pytest.raises(EngineError) as e:
        db.transaction(lambda tx: tx.users.find_many(lock={"mode": "share", "tables": ["users"]}))
    assert e.value.code == ErrorCode.LOCK_NOT_SUPPORTED
    for bad in ("nope", {"mode": "update", "noWait": True, "skipLocked": True}):
        with pytest.raises(EngineError):
            db.transaction(lambda tx, bad=bad: tx.users.find_many(lock=bad))


def test_path_store(spark, tmp_path):
    s = Schema({"t": Table({"id": Column("int", nullable=False), "v": Column("string", default="d")}, ("id",))})
    rows = spark.createDataFrame([(1, "a")], "id int, v string")
    db = Client.open(spark, s, {"t": rows}, path=str(tmp_path / "store"))
    db.t.create(data={"id": 2})
    db.transaction(lambda tx: [tx.t.create(data={"id": 3}), tx.t.update(where={"id": 1}, data={"v": "z"})])
    again = Client.open(spark, s, {"t": rows}, path=str(tmp_path / "store"))
    assert {r["id"]: r["v"] for r in again.t.find_many().value()} == {1: "z", 2: "d", 3: "d"}


def test_lineage_is_cut(spark):
    s = Schema({"t": Table({"id": Column("int", nullable=False), "at": Column("timestamp_ntz", default_factory=lambda: datetime(2024, 1, 1))}, ("id",))})
    db = Client.open(spark, s, {"t": spark.createDataFrame([(0, None)], "id int, at timestamp_ntz")}, cut_after=3)
    for i in range(1, 4):
        db.t.create(data={"id": i})
    assert "Scan parquet" in db.t.find_many().explain()["statements"]["data"]["plan"]
    assert db.t.count(where={"at": datetime(2024, 1, 1)}).value() == 3


def test_raw(db):
    assert db.raw("SELECT name FROM users WHERE id = :i", {"i": 2}) == [{"name": "Bob"}]
    assert db.raw("SELECT name FROM users WHERE id = ?", [3], map=lambda r: r["name"], comment="why */ not") == ["Charlie"]
    with pytest.raises(EngineError) as e:
        db.raw("SELECT nope FROM users")
    assert e.value.code == ErrorCode.DATABASE_ERROR
    with pytest.raises(EngineError) as e:
        db.raw(" ")
    assert e.value.code == ErrorCode.RAW_INVALID_QUERY
    with pytest.raises(EngineError) as e:
        db.raw_unsafe("SELECT 1")
    assert e.value.code == ErrorCode.RAW_UNSAFE_DISABLED
    assert db.execute_raw("UPDATE users SET age = age + :n, name = upper(name) WHERE active AND id > 1", {"n": 1}) == {"rowsAffected": 2}
    assert db.execute_raw("INSERT INTO posts (id, userId, title, body, score, published) VALUES (7, 1, 'a, b', 'x', 1, true)") == {"rowsAffected": 1}
    assert db.execute_raw("DELETE FROM posts WHERE title = 'a, b'") == {"rowsAffected": 1}
    assert db.users.find_unique(where={"id": 2}).value()["name"] == "BOB"
    with pytest.raises(EngineError):
        db.execute_raw("INSERT INTO users SELECT * FROM users")
    with pytest.raises(EngineError):
        db.execute_raw("DROP TABLE users")


def test_raw_guards(spark):
    open_ = lambda **raw: blog(spark, raw=raw)
    unsafe = open_(allowUnsafe=True)
    assert unsafe.raw_unsafe("SELECT '?' AS q, name FROM users WHERE id = ?", [1]) == [{"q": "?", "name": "Alice"}]
    for db, code, call in (
        (unsafe, ErrorCode.RAW_UNSAFE_PLACEHOLDER_MISMATCH, lambda d: d.raw_unsafe("SELECT ?", [])),
        (open_(enabled=False), ErrorCode.RAW_DISABLED, lambda d: d.raw("SELECT 1")),
        (open_(requireComment=True), ErrorCode.RAW_COMMENT_REQUIRED, lambda d: d.raw("SELECT 1")),
        (unsafe, ErrorCode.RAW_TIMEOUT, lambda d: d.raw("SELECT count(*) FROM range(100000000000) WHERE hash(id) = 7", timeoutMs=300)),
    ):
        with pytest.raises(EngineError) as e:
            call(db)
        assert e.value.code == code

from __future__ import annotations

import pytest
from blog import blog

from graphlake import EngineError, ErrorCode, UNSET


@pytest.fixture(scope="module")
def db(spark):
    return blog(spark)


def names(db, where):
    return {r["name"] for r in db.users.find_many(where=where).value()}


@pytest.mark.parametrize(
    ("where", "expected"),
    [
        ({"age": {"gt": 30}}, {"Charlie"}),
        ({"age": {"gte": 30}}, {"Bob", "Charlie"}),
        ({"age": {"lt": 25}}, {"Eve"}),
        ({"age": {"lte": 25}}, {"Alice", "Eve"}),
        ({"name": {"contains": "li"}}, {"Alice", "Charlie"}),
        ({"name": {"endsWith": "e"}}, {"Alice", "Charlie", "Eve"}),
        ({"name": {"contains": "AL", "mode": "insensitive"}}, {"Alice"}),
        ({"name": {"contains": "\\"}}, set()),
        ({"name": {"not": "Alice"}}, {"Bob", "Charlie", "Diana", "Eve"}),
        ({"NOT": [{"name": "Alice"}, {"name": "Bob"}]}, {"Charlie", "Diana", "Eve"}),
        ({"name": {"in": []}}, set()),
        ({"OR": []}, {"Alice", "Bob", "Charlie", "Diana", "Eve"}),
        ({"id": UNSET}, {"Alice", "Bob", "Charlie", "Diana", "Eve"}),
        ({"posts": {"some": {"published": True}}}, {"Alice", "Bob", "Diana"}),
        ({"posts": {"every": {"published": True}}}, {"Bob", "Diana", "Eve"}),
        ({"posts": {"none": {"published": True}}}, {"Charlie", "Eve"}),
        ({"posts": {"none": {}}}, {"Eve"}),
        ({"posts": {"every": {}}}, {"Eve"}),
        ({"posts": {"some": {"comments": {"some": {"author": {"is": {"name": "Bob"}}}}}}}, {"Alice"}),
        ({"NOT": {"posts": {"some": {}}}}, {"Eve"}),
    ],
)
def test_filters(db, where, expected):
    assert names(db, where) == expected


@pytest.mark.parametrize(("where", "n"), [({"author": {"is": {"name": "Alice"}}}, 2), ({"author": {"isNot": {"name": "Alice"}}}, 4), ({"author": {"isNot": None}}, 6), ({"author": {"is": None}}, 0)])
def test_relation_one(db, where, n):
    assert db.posts.count(where=where).value() == n


def test_unknown_columns_are_errors_unless_lenient(spark, db):
    with pytest.raises(EngineError):
        db.users.find_many(where={"nope": 1})
    assert blog(spark, lenient=True).users.count(where={"nope": 1}).value() == 5


def test_escape_like(spark, db):
    assert blog(spark, escape_like=True).users.count(where={"email": {"contains": "a%e"}}).value() == 0
    assert db.users.count(where={"email": {"startsWith": "a%e@"}}).value() == 1


def test_null_logic(spark):
    """NULLs drop from not, notIn and isNot, and a child with a NULL doesn't violate every."""
    from graphlake import Column, Schema, Table
    from graphlake.client import Client
    from graphlake.schema import many, one

    s = Schema(
        {"a": Table({"id": Column("int", nullable=False), "b": Column("int"), "x": Column("int")}, ("id",)), "b": Table({"id": Column("int", nullable=False), "y": Column("int")}, ("id",))},
        {"a": {"to": one("b", "b", "id")}, "b": {"of": many("a", "id", "b")}},
    )
    c = Client.open(spark, s, {"a": spark.createDataFrame([(1, 1, 5), (2, None, 6), (3, 2, None)], "id int, b int, x int"), "b": spark.createDataFrame([(1, 1), (2, None), (3, 3)], "id int, y int")})
    ids = lambda t, w: {r["id"] for r in c[t].find_many(where=w).value()}
    assert ids("a", {"x": {"not": 5}}) == {2}
    assert ids("a", {"x": {"notIn": [5]}}) == {2}
    assert ids("a", {"x": {"not": None}}) == {1, 2}
    assert ids("a", {"to": {"isNot": {"y": 1}}}) == {3}
    assert ids("a", {"to": {"isNot": {"y": 99}}}) == {1, 2, 3}  # NOT IN over an empty list
    assert ids("a", {"NOT": {"to": {"is": {"y": 1}}}}) == {3}
    assert ids("a", {"to": {"is": None}}) == {2}
    assert ids("b", {"of": {"every": {"x": {"gt": 4}}}}) == {1, 2, 3}
    assert ids("b", {"of": {"none": {"x": {"gt": 4}}}}) == {2, 3}
    rows = {r["id"]: r for r in c.a.find_many(include={"to": True}).value()}
    assert rows[2]["to"] is None and rows[3]["to"] == {"id": 2, "y": None}


def test_graph(db):
    rows = db.users.find_many(orderBy={"id": "asc"}, include={"posts": {"orderBy": {"score": "desc"}, "take": 1}, "_count": {"select": {"posts": {"where": {"published": True}}, "comments": True}}}).value()
    assert [[p["id"] for p in r["posts"]] for r in rows] == [[2], [4], [5], [6], []]
    assert [r["_count"] for r in rows] == [{"posts": 1, "comments": 2}, {"posts": 2, "comments": 1}, {"posts": 0, "comments": 2}, {"posts": 1, "comments": 0}, {"posts": 0, "comments": 0}]
    row = db.posts.find_first(where={"id": 1}, select={"title": True, "author": {"select": {"name": True}}, "comments": {"select": {"body": True}, "orderBy": {"id": "asc"}, "skip": 1}}).value()
    assert row == {"title": "First Post", "author": {"name": "Alice"}, "comments": [{"body": "Thanks!"}]}
    deep = db.users.find_first(where={"id": 1}, include={"posts": {"orderBy": {"id": "asc"}, "include": {"comments": {"orderBy": {"id": "desc"}, "include": {"author": True}}}}}).value()
    assert [c["author"]["name"] for c in deep["posts"][0]["comments"]] == ["Charlie", "Bob"]


@pytest.mark.parametrize("args", [{"select": {"id": True}, "include": {"posts": True}}, {"include": {"nope": True}}, {"select": {"nope": True}}, {"include": {"_count": {"select": {}}}}, {"include": {"_count": {"select": {"nope": True}}}}, {"include": {"_count": True}}, {"include": {"posts": {"lock": "update"}}}])
def test_bad_projections(db, args):
    with pytest.raises(EngineError):
        db.users.find_many(args)


def test_reads(db):
    assert db.users.find_first(orderBy={"age": "desc"}).value()["name"] == "Charlie"
    assert db.users.find_unique(where={"id": 99}).value() is None
    with pytest.raises(EngineError) as e:
        db.users.find_unique(where={"id": 99}).or_throw()
    assert e.value.code == ErrorCode.RESULT_NOT_FOUND and e.value.status == 404
    with pytest.raises(KeyError):
        db.users.find_unique(where={"id": 99}).or_throw(lambda: KeyError("x"))
    assert db.users.exists(where={"name": "Bob"}).value() and not db.users.exists(where={"name": "Zed"}).value()
    assert db.users.count(cursor={"id": 3}).value() == 2
    assert [r["id"] for r in db.users.find_many(orderBy={"id": "asc"}, take=-2).value()] == [1, 2]
    assert db.repository("users").count().value() == 5
    with pytest.raises(EngineError) as e:
        db.repository("nope")
    assert e.value.code == ErrorCode.REPOSITORY_NOT_FOUND


def test_paginate(db):
    page = db.users.paginate(orderBy={"id": "asc"}).value()
    assert page["pagination"] == {"type": "offset", "page": 1, "perPage": 10, "total": 5, "pageCount": 1, "hasNext": False, "hasPrevious": False}
    page = db.users.paginate(orderBy={"id": "asc"}, limit=2, skip=2).value()
    assert [r["id"] for r in page["data"]] == [3, 4]
    assert page["pagination"] == {"type": "offset", "page": 2, "perPage": 2, "total": 5, "pageCount": 3, "hasNext": True, "hasPrevious": True}
    meta = db.users.paginate(where={"name": "Zed"}).value()["pagination"]
    assert (meta["total"], meta["pageCount"], meta["page"]) == (0, 0, 1)


def test_cursor(db):
    first = db.users.cursor(orderBy={"id": "asc"}, limit=2).value()
    assert [r["id"] for r in first["data"]] == [1, 2]
    assert first["pagination"] == {"type": "cursor", "hasNext": True, "hasPrevious": False, "nextCursor": {"id": 2}, "previousCursor": None}
    second = db.users.cursor(orderBy={"id": "asc"}, limit=2, cursor={"after": {"id": 2}}).value()
    assert [r["id"] for r in second["data"]] == [3, 4]
    assert second["pagination"]["previousCursor"] == {"id": 3} and second["pagination"]["nextCursor"] == {"id": 4}
    before = db.users.cursor(orderBy={"id": "asc"}, limit=2, cursor={"before": {"id": 4}}).value()
    assert [r["id"] for r in before["data"]] == [2, 3]
    assert before["pagination"]["nextCursor"] == {"id": 3} and before["pagination"]["previousCursor"] == {"id": 2}
    assert [r["id"] for r in db.users.cursor(limit=2, cursor={"after": {"id": 4}}).value()["data"]] == [3, 2]
    for bad in ({"before": {"id": 1}, "after": {"id": 2}}, "x"):
        with pytest.raises(EngineError):
            db.users.cursor(cursor=bad)
    with pytest.raises(EngineError):
        db.users.cursor(orderBy={"id": "asc"}, select={"name": True})


@pytest.mark.parametrize(
    ("args", "ids"),
    [
        ({"orderBy": {"id": "asc"}}, [1, 2]),
        ({"orderBy": {"id": "asc"}, "skip": 1}, [2, 3]),
        ({"orderBy": {"id": "asc"}, "cursor": {"after": {"id": 2}}}, [3, 4]),
        ({"orderBy": {"id": "asc"}, "cursor": {"after": {"id": 4}}}, [5]),
        ({"orderBy": {"id": "asc"}, "cursor": {"before": {"id": 4}}}, [2, 3]),
        ({"orderBy": {"id": "asc"}, "cursor": {"before": {"id": 4}}, "include": {"posts": True}}, [2, 3]),
        ({"orderBy": {"id": "desc"}, "cursor": {"before": {"id": 2}}}, [4, 3]),
        ({"cursor": {"before": {"id": 4}}}, [2, 3]),
        ({"cursor": {"after": {"id": 4}}}, [3, 2]),
    ],
)
def test_cursor_frame_is_the_page(db, args, ids):
    page = db.users.cursor(args, limit=2)
    assert [r["id"] for r in page.df.collect()] == [r["id"] for r in page.value()["data"]] == ids


def test_cursor_explains_what_it_reads(db):
    """One row beyond the page tells whether there is a next one."""
    assert db.users.cursor(orderBy={"id": "asc"}, limit=2).explain(analyze=True)["statements"]["data"]["rows"] == 3


def test_json_paths(spark):
    import json

    from graphlake import Column, Schema, Table
    from graphlake.client import Client

    docs = [(i, json.dumps({"profile": {"active": i % 2 == 0, "age": 18 + i % 60, "name": f"User {i}", "n": None}})) for i in range(200)] + [(900, '{"profile": {"age": "20"}}'), (901, "not json"), (902, None)]
    c = Client.open(spark, Schema({"events": Table({"id": Column("int", nullable=False), "metadata": Column("string", json=True)}, ("id",))}), {"events": spark.createDataFrame(docs, "id int, metadata string")})
    n = lambda **paths: c.events.count(where={"metadata": {"json": {k.replace("_", "."): v for k, v in paths.items()}}}).value()
    assert n(profile_active=True) == 100
    assert n(profile_age=20) == sum(18 + i % 60 == 20 for i in range(200))
    assert n(profile_age="20") == 1
    assert n(profile_age={"gte": 30, "lt": 40}) == sum(30 <= 18 + i % 60 < 40 for i in range(200))
    assert n(profile_name={"startsWith": "User 1"}) == sum(str(i).startswith("1") for i in range(200))
    assert n(profile_n=None) == 200
    assert n(profile_missing=None) == 0
    assert n(profile_age={"in": [18, 19]}, profile_active=True) == sum(i % 60 in (0, 1) and i % 2 == 0 for i in range(200))
    assert n(profile_active={"not": True}) == 100


def test_explain(db):
    plan = db.posts.find_many(where={"author": {"is": {"name": "Alice"}}}, include={"comments": {"take": 1}}).explain()
    assert plan["deferredRelations"] == [{"path": "comments", "table": "comments", "cardinality": "many", "filtered": False, "sorted": False, "paginated": True, "through": None}]
    assert "Join" in plan["statements"]["data"]["plan"]
    assert set(db.users.paginate(limit=1).explain()["statements"]) == {"data", "total"}
    assert db.users.count().explain(analyze=True, timing=True)["statements"]["count"]["rows"] == 1
    with pytest.raises(EngineError):
        db.users.count().explain(nope=True)


def test_plans(spark, tmp_path):
    """Filters and columns reach the scan; a page by parent is limited before it is ranked."""
    spark.range(1000).selectExpr("id", "id % 10 AS userId", "id AS score").write.parquet(str(tmp_path / "posts"))
    spark.range(10).selectExpr("id", "concat('u', id) AS name").write.parquet(str(tmp_path / "users"))
    from graphlake import Column, Schema, Table
    from graphlake.client import Client
    from graphlake.schema import many

    s = Schema({"users": Table({"id": Column("bigint"), "name": Column("string")}, ("id",)), "posts": Table({"id": Column("bigint"), "userId": Column("bigint"), "score": Column("bigint")}, ("id",))}, {"users": {"posts": many("posts", "id", "userId")}})
    c = Client.open(spark, s, {n: str(tmp_path / n) for n in ("users", "posts")})
    plan = c.posts.find_many(where={"score": {"gt": 5}}, select={"id": True}).explain()["statements"]["data"]["plan"]
    assert "GreaterThan(score,5)" in plan and "ReadSchema: struct<id:bigint,score:bigint>" in plan
    assert "WindowGroupLimit" in c.users.find_many(include={"posts": {"take": 2, "skip": 1}}).explain()["statements"]["data"]["plan"]
    assert "TakeOrderedAndProject" in c.posts.find_many(orderBy={"score": "desc"}, take=5, skip=2).explain()["statements"]["data"]["plan"]
    assert "LeftSemi" in c.users.find_many(where={"posts": {"some": {}}}).explain()["statements"]["data"]["plan"]
    assert "LeftAnti" in c.users.find_many(where={"posts": {"none": {}}}).explain()["statements"]["data"]["plan"]

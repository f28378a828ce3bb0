"""Versions, commits of several writers, and what a small write rewrites."""

from __future__ import annotations

from decimal import Decimal
from pathlib import Path

import pytest
from blog import blog
from pyspark.sql import functions as F

from graphlake import Column, EngineError, ErrorCode, Schema, Table
from graphlake.client import Client

S = Schema({n: Table({"id": Column("bigint", nullable=False), "v": Column("string")}, ("id",)) for n in "tu"})


def opened(spark, path, n=100):
    rows = spark.range(n).select("id", F.lit("a").alias("v")).repartition(4, "id")
    return Client.open(spark, S, {"t": rows, "u": rows}, path=str(path))


def values(c, table="t"):
    return {r["id"]: r["v"] for r in c[table].find_many().value()}


def files(path, table="t"):
    return {str(p) for p in Path(path, table).rglob("*.parquet")}


@pytest.mark.parametrize("stored", [True, False])
def test_versions_are_immutable(spark, tmp_path, stored):
    c = opened(spark, tmp_path / "s") if stored else Client.open(spark, S, {"t": spark.createDataFrame([], "id bigint, v string")})
    random = spark.range(1000, 1050).select("id", F.uuid().alias("v"))
    assert c.t.create_many(data=random) == {"count": 50}
    assert values(c) == values(c)
    c.execute_raw("UPDATE t SET v = uuid() WHERE id >= 1000")
    assert values(c) == values(c)
    source = tmp_path / "source"
    spark.range(2000, 2010).select("id", F.lit("s").alias("v")).write.parquet(str(source))
    c.t.create_many(data=spark.read.parquet(str(source)))
    spark.range(5).select("id", F.lit("z").alias("v")).write.mode("overwrite").parquet(str(source))
    assert sum(v == "s" for v in values(c).values()) == 10


def test_two_writers(spark, tmp_path):
    a, b = opened(spark, tmp_path / "s"), opened(spark, tmp_path / "s")
    a.t.update(where={"id": 1}, data={"v": "A"})
    assert values(b)[1] == "A"  # a later snapshot sees it
    b.t.update(where={"id": 2}, data={"v": "B"})
    assert values(a)[2] == "B"

    def raced(client, other, table, tries=[]):  # noqa: B006
        def work(tx):
            tx.t.update(where={"id": 3}, data={"v": "C"})
            if not tries:
                tries.append(1)
                other[table].update(where={"id": 4}, data={"v": "D"})

        return work

    a.transaction(raced(a, b, "u", []))  # of another table: both stand
    assert values(b)[3] == "C" and values(b, "u")[4] == "D"
    with pytest.raises(EngineError) as e:
        b.transaction(raced(b, a, "t", []))
    assert e.value.code == ErrorCode.DATABASE_ERROR
    b.transaction(raced(b, a, "t", []), retry={"attempts": 2})
    assert values(a)[4] == "D" and values(opened(spark, tmp_path / "s")) == values(a) == values(b)
    assert not [p for p in Path(tmp_path, "s", "commits").iterdir() if not p.name.strip(".").split(".")[0].isdigit()]


def test_a_small_write_rewrites_few_files(spark, tmp_path):
    c = opened(spark, tmp_path / "s")
    c.t.create(data={"id": 500, "v": "first"})  # the first commit writes the whole table
    old = files(tmp_path / "s")

    def listed():
        return set(c.store.files["t"])

    def step(work, most_gone):
        before = listed()
        work()
        assert len(before - listed()) <= most_gone and len(listed() - before) <= 3 and files(tmp_path / "s") >= old
        return before

    step(lambda: c.t.update(where={"id": 7}, data={"v": "x"}), 1)
    step(lambda: c.t.create(data={"id": 501, "v": "y"}), 0)
    step(lambda: c.t.delete(where={"id": 8}), 1)
    step(lambda: c.t.update_each(by="id", data=[{"id": 9, "v": "e"}]), 1)
    step(lambda: c.t.upsert_many(data=[{"id": 10, "v": "u"}, {"id": 600, "v": "n"}], target="id"), 1)
    assert step(lambda: c.t.update(where={"id": 12345}, data={"v": "x"}), 0) == listed()
    step(lambda: c.transaction(lambda tx: [tx.t.create(data={"id": 700 + i, "v": "t"}) for i in range(2)]), 0)
    want = {i: "a" for i in range(100)} | {500: "first", 7: "x", 501: "y", 9: "e", 10: "u", 600: "n", 700: "t", 701: "t"}
    del want[8]
    assert values(c) == want == values(opened(spark, tmp_path / "s"))
    with pytest.raises(EngineError):
        c.t.create(data={"id": 10, "v": "again"})

    def undone(tx):
        tx.t.update(where={"id": 1}, data={"v": "no"})
        tx.rollback()

    with pytest.raises(EngineError):
        c.transaction(undone)
    assert values(c) == want


def test_raw_leaves_the_sessions_views(spark):
    spark.range(3).createOrReplaceTempView("users")
    c = blog(spark)
    assert c.raw("SELECT count(*) AS n FROM users") == [{"n": 5}]
    assert c.execute_raw("DELETE FROM posts WHERE id = 1") == {"rowsAffected": 1}
    assert spark.table("users").count() == 3 and not spark.catalog.tableExists("posts")
    spark.catalog.dropTempView("users")


def test_json_numbers(spark):
    s = Schema({"t": Table({"id": Column("int", nullable=False), "doc": Column("string")}, ("id",))})
    docs = ['{"n": 9007199254740993}', '{"n": 9007199254740992}', '{"n": 0.1}', '{"n": 1e3}', '{"n": "5"}', '{"n": true}', '{"n": null}', "{}", "x", '{"n": 20.5}']
    c = Client.open(spark, s, {"t": spark.createDataFrame(list(enumerate(docs)), "id int, doc string")})
    ids = lambda n: sorted(r["id"] for r in c.t.find_many(where={"doc": {"json": {"n": n}}}).value())
    assert ids(9007199254740993) == [0] and ids(9007199254740992) == [1] and ids({"gt": 9007199254740992}) == [0]
    assert ids(0.1) == [2] and ids(Decimal("0.1")) == [2] and ids(1000) == [3] and ids({"lt": 21, "gte": 20}) == [9] and ids(20) == []
    assert ids({"in": [0.1, 20.5]}) == [2, 9] and ids({"not": 1000}) == [0, 1, 2, 4, 5, 6, 9]
    assert ids({"gt": "5"}) == list(range(10)) and ids({"lt": True}) == list(range(10))  # no condition
    assert ids(float("inf")) == []


def test_counts_of_a_page_read_its_children_alone(spark):
    c = blog(spark)
    got = c.users.find_many(orderBy={"id": "asc"}, take=2, include={"_count": {"select": {"posts": {"where": {"published": True}}}}})
    assert [r["_count"] for r in got.value()] == [{"posts": 1}, {"posts": 2}]
    assert "LeftSemi" in got.explain()["statements"]["data"]["plan"]


def test_selectors_are_found_together(spark):
    c = blog(spark)
    c.users.update(where={"id": 5}, data={"posts": {"connect": [{"id": 1}, {"id": 2}, {"title": "Third Post"}, {"id": 1}]}})
    assert {r["id"] for r in c.posts.find_many(where={"userId": 5}).value()} == {1, 2, 3}
    for bad in ([{"id": 4}, {"id": 99}], [{"published": True}, {"published": False}], [{"id": 4}, {"nope": 1}], [{"id": 4}, {}]):
        with pytest.raises(EngineError):
            c.users.update(where={"id": 5}, data={"posts": {"connect": bad}})


def test_lock_errors_of_databases():
    class Locked(Exception):
        sqlstate = "55P03"

    class Numbered(Exception):
        errno = 1205

    for e in (Locked("x"), Numbered("x"), Exception("ERROR: could not obtain lock on row"), Exception("lock timeout")):
        assert EngineError.of(e).code == ErrorCode.LOCK_TIMEOUT and EngineError.of(e).status == 408
    assert EngineError.of(Exception("x")).code == ErrorCode.UNKNOWN

"""A small blog: users, posts, comments, memberships."""

from __future__ import annotations

from graphlake import Column, Schema, Table
from graphlake.client import Client
from graphlake.schema import many, one


def _t(key: str, unique=(), **cols: str) -> Table:
    return Table({k: Column(t, source={"userId": "user_id", "postId": "post_id", "authorId": "author_id"}.get(k), nullable=False) for k, t in cols.items()}, (key,), unique)


def schema() -> Schema:
    return Schema(
        {
            "users": _t("id", (("email",),), id="int", email="string", name="string", age="int", active="boolean"),
            "posts": _t("id", id="int", userId="int", title="string", body="string", score="int", published="boolean"),
            "comments": _t("id", id="int", postId="int", authorId="int", body="string", likes="int"),
            "memberships": _t("id", (("userId", "label"),), id="int", userId="int", label="string", note="string"),
        },
        {
            "users": {"posts": many("posts", "id", "userId"), "comments": many("comments", "id", "authorId")},
            "posts": {"author": one("users", "userId", "id"), "comments": many("comments", "id", "postId")},
            "comments": {"author": one("users", "authorId", "id"), "post": one("posts", "postId", "id")},
        },
    )


USERS = [(1, "alice@example.com", "Alice", 25, True), (2, "bob@example.com", "Bob", 30, True), (3, "charlie@example.com", "Charlie", 35, False), (4, "diana@example.com", "Diana", 28, True), (5, "eve@example.com", "Eve", 22, False)]
POSTS = [(1, 1, "First Post", "Body 1", 10, True), (2, 1, "Second Post", "Body 2", 20, False), (3, 2, "Third Post", "Body 3", 30, True), (4, 2, "Fourth Post", "Body 4", 40, True), (5, 3, "Fifth Post", "Body 5", 50, False), (6, 4, "Sixth Post", "Body 6", 60, True)]
COMMENTS = [(1, 1, 2, "Nice post!", 5), (2, 1, 3, "Thanks!", 2), (3, 3, 1, "Great work", 8), (4, 4, 3, "Interesting", 1), (5, 6, 1, "Well done", 3)]
MEMBERSHIPS = [(1, 1, "owner", "Initial owner"), (2, 2, "editor", "Initial editor")]


def blog(spark, **options) -> Client:
    f = spark.createDataFrame
    rows = {
        "users": f(USERS, "id int, email string, name string, age int, active boolean"),
        "posts": f(POSTS, "id int, user_id int, title string, body string, score int, published boolean"),
        "comments": f(COMMENTS, "id int, post_id int, author_id int, body string, likes int"),
        "memberships": f(MEMBERSHIPS, "id int, user_id int, label string, note string"),
    }
    return Client.open(spark, schema(), rows, **options)

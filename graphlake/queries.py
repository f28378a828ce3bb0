"""One query an operator over the test tables, each with the DuckDB SQL of the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlake.client import Client
from graphlake.domain import client
from graphlake.domain import schema as domain_schema
from graphlake.plugins import soft_delete, timestamps
from graphlake.schema import Column, Schema, Table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

Build = Callable[[Client], DataFrame]


def add(name: str, build: Build, sql: str | None) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(client(spark, sf_dir))
    if sql is not None:
        ORACLES[name] = sql


def frame(c: Client, row: dict, ddl: str) -> DataFrame:
    """A result of one row."""
    return c.spark.createDataFrame([tuple(row.values())], ddl)


# 2.2 scalar predicates

_O = {"o_orderkey": True, "o_totalprice": True}


def _where(name: str, table: str, key: str, where: object, sql: str) -> None:
    add(name, lambda c: c[table].find_many(where=where, select={key: True}).df, f"SELECT {key} FROM {table} WHERE {sql}")


_where("where_eq", "orders", "o_orderkey", {"o_orderstatus": "F"}, "o_orderstatus = 'F'")
_where("where_equals", "orders", "o_orderkey", {"o_orderstatus": {"equals": "O"}}, "o_orderstatus = 'O'")
_where("where_not_null", "orders", "o_orderkey", {"o_orderpriority": {"not": None}}, "o_orderpriority IS NOT NULL")
_where("where_in", "customer", "c_custkey", {"c_mktsegment": {"in": ["BUILDING", "MACHINERY"]}}, "c_mktsegment IN ('BUILDING', 'MACHINERY')")
_where("where_not_in", "customer", "c_custkey", {"c_mktsegment": {"notIn": ["BUILDING", "MACHINERY"]}}, "c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
_where("where_in_empty", "customer", "c_custkey", {"c_mktsegment": {"in": []}}, "FALSE")
_where("where_not_in_empty", "customer", "c_custkey", {"c_mktsegment": {"notIn": []}}, "TRUE")
_where("where_lt", "part", "p_partkey", {"p_size": {"lt": 10}}, "p_size < 10")
_where("where_lte", "part", "p_partkey", {"p_size": {"lte": 10}}, "p_size <= 10")
_where("where_gt", "part", "p_partkey", {"p_size": {"gt": 40}}, "p_size > 40")
_where("where_gte", "part", "p_partkey", {"p_size": {"gte": 40}}, "p_size >= 40")
_where("where_range", "orders", "o_orderkey", {"o_totalprice": {"gte": 50000, "lt": 150000}}, "o_totalprice >= 50000 AND o_totalprice < 150000")
_where("where_contains", "part", "p_partkey", {"p_name": {"contains": "ing"}}, "p_name LIKE '%ing%'")
_where("where_starts_with", "customer", "c_custkey", {"c_name": {"startsWith": "Customer#00000"}}, "c_name LIKE 'Customer#00000%'")
_where("where_ends_with", "customer", "c_custkey", {"c_name": {"endsWith": "7"}}, "c_name LIKE '%7'")
_where("where_contains_insensitive", "customer", "c_custkey", {"c_mktsegment": {"contains": "build", "mode": "insensitive"}}, "c_mktsegment ILIKE '%build%'")
_where("where_like_wildcard", "customer", "c_custkey", {"c_name": {"contains": "#0_0"}}, "c_name LIKE '%#0_0%'")
_where("where_not_value", "orders", "o_orderkey", {"o_orderstatus": {"not": "F"}}, "NOT (o_orderstatus = 'F')")
_where("where_not_filter", "orders", "o_orderkey", {"o_totalprice": {"not": {"gt": 100000}}}, "NOT (o_totalprice > 100000)")
_where("where_and", "orders", "o_orderkey", {"AND": [{"o_orderstatus": "F"}, {"o_totalprice": {"gt": 100000}}]}, "o_orderstatus = 'F' AND o_totalprice > 100000")
_where("where_or", "orders", "o_orderkey", {"OR": [{"o_orderstatus": "F"}, {"o_totalprice": {"gt": 200000}}]}, "o_orderstatus = 'F' OR o_totalprice > 200000")
_where("where_not", "orders", "o_orderkey", {"NOT": {"o_orderstatus": "F"}}, "NOT (o_orderstatus = 'F')")
_where("where_not_list", "orders", "o_orderkey", {"NOT": [{"o_orderstatus": "F"}, {"o_orderstatus": "O"}]}, "NOT (o_orderstatus = 'F') AND NOT (o_orderstatus = 'O')")
_where("where_empty_or", "nation", "n_nationkey", {"OR": []}, "TRUE")
_where("where_nested_logic", "orders", "o_orderkey", {"OR": [{"AND": [{"o_orderstatus": "F"}, {"NOT": {"o_totalprice": {"lt": 100000}}}]}, {"o_orderpriority": {"startsWith": "1"}}]}, "(o_orderstatus = 'F' AND NOT (o_totalprice < 100000)) OR o_orderpriority LIKE '1%'")
_where("where_siblings", "orders", "o_orderkey", {"o_orderstatus": "F", "o_totalprice": {"gt": 100000}}, "o_orderstatus = 'F' AND o_totalprice > 100000")
_where("where_date", "orders", "o_orderkey", {"o_orderdate": {"gte": datetime(1996, 1, 1), "lt": datetime(1997, 1, 1)}}, "o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'")
_where("where_raw_predicate", "orders", "o_orderkey", "o_totalprice % 2 < 1", "o_totalprice % 2 < 1")

# 2.3 JSON paths

_K = "json_extract(props, '$.k')"
_where("json_eq", "events", "event_id", {"props": {"json": {"k": 42}}}, f"json_type(props, '$.k') IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND CAST({_K} AS DOUBLE) = 42")
_where("json_range", "events", "event_id", {"props": {"json": {"k": {"gte": 20, "lt": 40}}}}, f"json_type(props, '$.k') IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND CAST({_K} AS DOUBLE) >= 20 AND CAST({_K} AS DOUBLE) < 40")
_where("json_in", "events", "event_id", {"props": {"json": {"k": {"in": [1, 2, 3]}}}}, f"CAST({_K} AS DOUBLE) IN (1, 2, 3)")
_where("json_not_in", "events", "event_id", {"props": {"json": {"k": {"notIn": [1, 2, 3]}}}}, f"CAST({_K} AS DOUBLE) NOT IN (1, 2, 3)")
_where("json_not", "events", "event_id", {"props": {"json": {"k": {"not": 42}}}}, f"NOT (CAST({_K} AS DOUBLE) = 42)")

# 2.4 relation predicates

_BIG = {"o_totalprice": {"gt": 250000}}
_link = "SELECT 1 FROM orders WHERE o_custkey = c_custkey"
_where("rel_some", "customer", "c_custkey", {"orders": {"some": _BIG}}, f"EXISTS ({_link} AND o_totalprice > 250000)")
_where("rel_none", "customer", "c_custkey", {"orders": {"none": _BIG}}, f"NOT EXISTS ({_link} AND o_totalprice > 250000)")
_where("rel_every", "customer", "c_custkey", {"orders": {"every": {"o_totalprice": {"lt": 250000}}}}, f"NOT EXISTS ({_link} AND NOT (o_totalprice < 250000))")
_lines = "SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey"
_where("rel_none_empty", "orders", "o_orderkey", {"lineitems": {"none": {}}}, f"NOT EXISTS ({_lines})")
_where("rel_every_empty", "orders", "o_orderkey", {"lineitems": {"every": {}}}, f"NOT EXISTS ({_lines})")
_where("rel_some_and_none", "customer", "c_custkey", {"orders": {"some": {"o_orderstatus": "F"}, "none": _BIG}}, f"EXISTS ({_link} AND o_orderstatus = 'F') AND NOT EXISTS ({_link} AND o_totalprice > 250000)")
_where("rel_is", "orders", "o_orderkey", {"customer": {"is": {"c_mktsegment": "BUILDING"}}}, "o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
_where("rel_is_not", "orders", "o_orderkey", {"customer": {"isNot": {"c_mktsegment": "BUILDING"}}}, "o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
_where("rel_is_null", "documents", "doc_id", {"label": {"is": None}}, "NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id)")
_where("rel_is_not_null", "documents", "doc_id", {"label": {"isNot": None}}, "EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id)")
_where("rel_not_is", "orders", "o_orderkey", {"NOT": {"customer": {"is": {"c_acctbal": {"lt": 0}}}}}, "NOT (o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0))")
_where("rel_nested", "region", "r_regionkey", {"nations": {"some": {"customers": {"some": {"orders": {"some": _BIG}}}}}}, f"EXISTS (SELECT 1 FROM nation WHERE n_regionkey = r_regionkey AND EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND EXISTS ({_link} AND o_totalprice > 250000)))")
_where("rel_or_scalar", "customer", "c_custkey", {"OR": [{"c_acctbal": {"lt": 0}}, {"NOT": {"orders": {"some": {}}}}]}, f"c_acctbal < 0 OR NOT EXISTS ({_link})")
_where("rel_self_path", "customer", "c_custkey", {"nation": {"is": {"customers": {"some": {"c_acctbal": {"gt": 9900}}}}}}, "c_nationkey IN (SELECT n_nationkey FROM nation WHERE EXISTS (SELECT 1 FROM customer c2 WHERE c2.c_nationkey = n_nationkey AND c2.c_acctbal > 9900))")
_m2m = "SELECT 1 FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_partkey = p_partkey AND s_acctbal < 0"
_where("rel_m2m_some", "part", "p_partkey", {"supplier": {"some": {"s_acctbal": {"lt": 0}}}}, f"EXISTS ({_m2m})")
_where("rel_m2m_none", "part", "p_partkey", {"supplier": {"none": {"s_acctbal": {"lt": 0}}}}, f"NOT EXISTS ({_m2m})")
_where("rel_m2m_every", "part", "p_partkey", {"supplier": {"every": {"s_acctbal": {"gte": 0}}}}, f"NOT EXISTS ({_m2m})")

# 2.5 projection and graph

add("select_scalar", lambda c: c.nation.find_many(select={"n_name": True, "n_nationkey": True}).df, "SELECT n_name, n_nationkey FROM nation")
add("select_empty", lambda c: c.region.find_many(select={}).df, "SELECT r_regionkey, r_name FROM region")
add(
    "select_nested_flat",
    lambda c: c.orders.find_many(select={"o_orderkey": True, "customer": {"select": {"c_name": True}}}).df.select("o_orderkey", "customer.c_name"),
    "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey",
)
add(
    "include_one_flat",
    lambda c: c.documents.find_many(include={"label": True}).df.select("doc_id", F.col("label.quality").alias("quality"), F.col("label").isNull().alias("missing")),
    "SELECT d.doc_id, quality, l.doc_id IS NULL AS missing FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
)
add(
    "include_many_flat",
    lambda c: c.customer.find_many(where={"c_acctbal": {"gt": 5000}}, include={"orders": {"where": {"o_orderstatus": "F"}}}).df.select("c_custkey", F.explode("orders").alias("o")).select("c_custkey", "o.o_orderkey", "o.o_totalprice"),
    "SELECT c_custkey, o_orderkey, o_totalprice FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal > 5000 AND o_orderstatus = 'F'",
)
add(
    "include_many_empty",
    lambda c: c.customer.find_many(include={"orders": {"where": _BIG}}).df.select("c_custkey", F.size("orders").alias("n")),
    "SELECT c_custkey, CAST((SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000) AS INTEGER) AS n FROM customer",
)
add(
    "include_m2m_flat",
    lambda c: c.supplier.find_many(where={"s_acctbal": {"lt": 0}}, include={"part": {"where": {"p_size": {"lt": 5}}}}).df.select("s_suppkey", F.explode("part").alias("p")).select("s_suppkey", "p.p_partkey"),
    "SELECT DISTINCT s_suppkey, p_partkey FROM supplier JOIN lineitem ON l_suppkey = s_suppkey JOIN part ON p_partkey = l_partkey WHERE s_acctbal < 0 AND p_size < 5",
)
add(
    "include_deep_flat",
    lambda c: c.region.find_many(include={"nations": {"include": {"suppliers": {"where": {"s_acctbal": {"gt": 5000}}}}}}).df.select("r_name", F.explode("nations").alias("n")).select("r_name", "n.n_name", F.explode("n.suppliers").alias("s")).select("r_name", "n_name", "s.s_suppkey"),
    "SELECT r_name, n_name, s_suppkey FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey WHERE s_acctbal > 5000",
)
add(
    "include_many_nested",
    lambda c: c.nation.find_many(include={"customers": {"orderBy": {"c_acctbal": "desc"}, "take": 3}, "region": True}).df.select("n_nationkey", "region.r_name", F.posexplode("customers").alias("place", "row")).select("n_nationkey", "r_name", "place", "row.c_custkey", "row.c_acctbal"),
    "SELECT n_nationkey, r_name, CAST(place - 1 AS INTEGER) AS place, c_custkey, c_acctbal FROM nation JOIN region ON r_regionkey = n_regionkey JOIN (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC NULLS LAST, c_custkey) AS place FROM customer) ON c_nationkey = n_nationkey WHERE place <= 3",
)
_pick = lambda rows: rows.select("c_custkey", F.posexplode("orders").alias("pos", "o")).select("c_custkey", "pos", "o.o_orderkey")
_paged = "SELECT o_custkey AS c_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders"
add("rel_page", lambda c: _pick(c.customer.find_many(include={"orders": {"orderBy": {"o_totalprice": "desc"}, "take": 2}}).df), f"SELECT c_custkey, CAST(rn - 1 AS INTEGER) AS pos, o_orderkey FROM ({_paged}) WHERE rn <= 2")
add("rel_page_skip", lambda c: _pick(c.customer.find_many(include={"orders": {"orderBy": {"o_totalprice": "desc"}, "take": 2, "skip": 1}}).df), f"SELECT c_custkey, CAST(rn - 2 AS INTEGER) AS pos, o_orderkey FROM ({_paged}) WHERE rn > 1 AND rn <= 3")
add("rel_page_cursor", lambda c: _pick(c.customer.find_many(include={"orders": {"orderBy": {"o_totalprice": "desc"}, "cursor": {"o_totalprice": 150000}, "take": 2}}).df), f"SELECT c_custkey, CAST(rn - 1 AS INTEGER) AS pos, o_orderkey FROM ({_paged.replace('FROM orders', 'FROM orders WHERE o_totalprice < 150000')}) WHERE rn <= 2")
add(
    "rel_page_m2m",
    lambda c: c.supplier.find_many(include={"part": {"orderBy": {"p_retailprice": "desc"}, "take": 1, "skip": 1}}).df.select("s_suppkey", F.explode("part").alias("p")).select("s_suppkey", "p.p_partkey"),
    "SELECT s_suppkey, p_partkey FROM (SELECT l_suppkey AS s_suppkey, p_partkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY p_retailprice DESC, p_partkey) AS rn FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) JOIN part ON p_partkey = l_partkey) WHERE rn = 2",
)
add(
    "rel_page_deep",
    lambda c: c.nation.find_many(include={"customers": {"orderBy": {"c_acctbal": "desc"}, "take": 2, "include": {"orders": {"orderBy": {"o_orderkey": "asc"}, "take": 2, "skip": 1}}}}).df.select("n_nationkey", F.explode("customers").alias("c")).select("n_nationkey", "c.c_custkey", F.explode("c.orders").alias("o")).select("n_nationkey", "c_custkey", "o.o_orderkey"),
    """SELECT n_nationkey, c_custkey, o_orderkey FROM (SELECT c_nationkey AS n_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rc FROM customer)
    JOIN (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS ro FROM orders) ON o_custkey = c_custkey WHERE rc <= 2 AND ro > 1 AND ro <= 3""",
)
_n = lambda rows, key, rel: rows.select(key, F.col(f"_count.{rel}").alias("n"))
add("count_rel", lambda c: _n(c.customer.find_many(include={"_count": {"select": {"orders": True}}}).df, "c_custkey", "orders"), "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer")
add("count_rel_where", lambda c: _n(c.customer.find_many(include={"_count": {"select": {"orders": {"where": {"o_orderstatus": "F"}}}}}).df, "c_custkey", "orders"), "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS n FROM customer")
add("count_m2m", lambda c: _n(c.part.find_many(include={"_count": {"select": {"supplier": {"where": {"s_acctbal": {"gt": 0}}}}}}).df, "p_partkey", "supplier"), "SELECT p_partkey, (SELECT count(*) FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) JOIN supplier ON s_suppkey = l_suppkey WHERE l_partkey = p_partkey AND s_acctbal > 0) AS n FROM part")
add(
    "count_nested",
    lambda c: c.region.find_many(include={"nations": {"include": {"_count": {"select": {"customers": True}}}}}).df.select("r_regionkey", F.explode("nations").alias("n")).select("r_regionkey", "n.n_nationkey", F.col("n._count.customers").alias("n")),
    "SELECT r_regionkey, n_nationkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS n FROM region JOIN nation ON n_regionkey = r_regionkey",
)

# 2.6 order, limit, keyset

_by = [{"o_totalprice": "desc"}, {"o_orderkey": "asc"}]
_ordered = "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey"


def _placed(df: DataFrame) -> DataFrame:
    """Each row's key with its place in the order."""
    rows = df.rdd.zipWithIndex().map(lambda x: (x[0][0], x[1] + 1))
    return df.sparkSession.createDataFrame(rows, "c_custkey long, place long")


add("order_multi", lambda c: _placed(c.customer.find_many(orderBy=[{"c_mktsegment": "asc"}, {"c_acctbal": "desc"}, {"c_custkey": "asc"}], select={"c_custkey": True}).df), "SELECT c_custkey, row_number() OVER (ORDER BY c_mktsegment NULLS FIRST, c_acctbal DESC NULLS LAST, c_custkey) AS place FROM customer")
add("take", lambda c: c.orders.find_many(orderBy=_by, take=25, select=_O).df, f"{_ordered} LIMIT 25")
add("skip", lambda c: c.orders.find_many(orderBy=_by, take=25, skip=10, select=_O).df, f"{_ordered} LIMIT 25 OFFSET 10")
add("take_negative", lambda c: c.orders.find_many(orderBy=_by, take=-25, select=_O).df, f"{_ordered} LIMIT 25")
add("keyset_desc", lambda c: c.orders.find_many(orderBy=_by, take=25, cursor={"o_totalprice": 200000}, select=_O).df, f"{_ordered.replace('ORDER', 'WHERE o_totalprice < 200000 ORDER')} LIMIT 25")
add("keyset_negative_take", lambda c: c.orders.find_many(orderBy={"o_orderkey": "asc"}, take=-25, cursor={"o_custkey": 40}, select={"o_orderkey": True, "o_custkey": True}).df, "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey < 40 ORDER BY o_orderkey LIMIT 25")

# 2.7 reads

_F = {"o_orderstatus": "F"}
add("find_first", lambda c: c.orders.find_first(where=_F, orderBy=_by, select=_O).df, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 1")
add("find_one", lambda c: c.orders.find_one(where={"o_orderkey": 7}, select=_O).df, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 7")
add("find_unique", lambda c: c.customer.find_unique(where={"c_custkey": 5}).df, "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey = 5")
add("count_all", lambda c: c.orders.count().df, "SELECT count(*) AS count FROM orders")
add("count_where", lambda c: c.orders.count(where=_F).df, "SELECT count(*) AS count FROM orders WHERE o_orderstatus = 'F'")
add("count_cursor", lambda c: c.orders.count(cursor={"o_orderkey": 100}).df, "SELECT count(*) AS count FROM orders WHERE o_orderkey > 100")
add("exists_true", lambda c: frame(c, {"found": c.orders.exists(where=_F).value()}, "found boolean"), "SELECT EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'F') AS found")
add("exists_false", lambda c: frame(c, {"found": c.orders.exists(where={"o_orderkey": -1}).value()}, "found boolean"), "SELECT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = -1) AS found")
add("paginate_data", lambda c: c.orders.paginate(where=_F, orderBy=_by, limit=20, skip=40, select=_O).df, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")


def _meta(c: Client, where: dict) -> DataFrame:
    m = c.orders.paginate(where=where, orderBy=_by, limit=20, skip=40).value()["pagination"]
    return frame(c, {k: m[k] for k in ("page", "perPage", "total", "pageCount", "hasNext", "hasPrevious")}, "page long, perPage long, total long, pageCount long, hasNext boolean, hasPrevious boolean")


_META = "SELECT CAST(3 AS BIGINT) AS page, CAST(20 AS BIGINT) AS perPage, count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS pageCount, 60 < count(*) AS hasNext, count(*) > 0 AS hasPrevious FROM orders WHERE "
add("paginate_meta", lambda c: _meta(c, _F), _META + "o_orderstatus = 'F'")
add("paginate_empty_meta", lambda c: _meta(c, {"o_orderkey": -1}), _META + "o_orderkey = -1")


def _page(c: Client, **args) -> DataFrame:
    rows = c.orders.cursor(select=_O, **args).value()["data"]
    return c.spark.createDataFrame([(i, r["o_orderkey"], r["o_totalprice"]) for i, r in enumerate(rows)], "pos long, o_orderkey long, o_totalprice double")


def _page_sql(where: str, order: str, limit: int, reverse: str | None = None) -> str:
    inner = f"SELECT o_orderkey, o_totalprice FROM orders WHERE {where} ORDER BY {order} LIMIT {limit}"
    return f"SELECT row_number() OVER (ORDER BY {reverse or order}) - 1 AS pos, o_orderkey, o_totalprice FROM ({inner})"


_key = {"o_orderkey": "asc"}
add("cursor_first", lambda c: _page(c, orderBy=_key, limit=15), _page_sql("TRUE", "o_orderkey", 15))
add("cursor_after", lambda c: _page(c, orderBy=_key, limit=15, cursor={"after": {"o_orderkey": 100}}), _page_sql("o_orderkey > 100", "o_orderkey", 15))
add("cursor_before", lambda c: _page(c, orderBy=_key, limit=15, cursor={"before": {"o_orderkey": 100}}), _page_sql("o_orderkey < 100", "o_orderkey DESC", 15, "o_orderkey"))
add("cursor_inferred_after", lambda c: _page(c, limit=15, cursor={"after": {"o_orderkey": 100}}), _page_sql("o_orderkey < 100", "o_orderkey DESC", 15))


def _cursor_meta(c: Client) -> DataFrame:
    m = c.orders.cursor(orderBy=_key, limit=15, cursor={"after": {"o_orderkey": 100}}).value()["pagination"]
    return frame(c, {"hasNext": m["hasNext"], "hasPrevious": m["hasPrevious"], "next": m["nextCursor"]["o_orderkey"], "previous": m["previousCursor"]["o_orderkey"]}, "hasNext boolean, hasPrevious boolean, next long, previous long")


add("cursor_meta", _cursor_meta, "WITH p AS (SELECT o_orderkey FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 15) SELECT (SELECT count(*) FROM orders WHERE o_orderkey > 100) > 15 AS hasNext, EXISTS (SELECT 1 FROM orders WHERE o_orderkey < (SELECT min(o_orderkey) FROM p)) AS hasPrevious, max(o_orderkey) AS next, min(o_orderkey) AS previous FROM p")

# 2.8 writes: the state they leave

_ROW = {"s_suppkey": 900001, "s_name": "New", "s_nationkey": 3, "s_acctbal": 1.5}
_SUP = "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier"


def _state(name: str, write: Callable[[Client], object], sql: str, table: str = "supplier", **options) -> None:
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = client(spark, sf_dir, **options)
        write(c)
        return c[table].find_many().df

    QUERIES[name] = build
    ORACLES[name] = sql


_state("create", lambda c: c.supplier.create(data=_ROW), f"{_SUP} UNION ALL SELECT 900001, 'New', 3, 1.5")
_state("create_skip_duplicates", lambda c: c.supplier.create(data=_ROW | {"s_suppkey": 1}, skipDuplicates=True), _SUP)
_state("create_many", lambda c: c.supplier.create_many(data=[_ROW, _ROW | {"s_suppkey": 900002}]), f"{_SUP} UNION ALL SELECT unnest([900001, 900002]), 'New', 3, 1.5")
_state("create_many_skip_target", lambda c: c.supplier.create_many(data=[_ROW, _ROW | {"s_name": "Second"}, _ROW | {"s_suppkey": 1}], skipDuplicates=["s_suppkey"]), f"{_SUP} UNION ALL SELECT 900001, 'New', 3, 1.5")
_state("create_many_from_frame", lambda c: c.supplier.create_many(data=c.spark.range(900001, 901001).selectExpr("id AS s_suppkey", "'bulk' AS s_name", "CAST(0 AS INT) AS s_nationkey", "CAST(id AS DOUBLE) AS s_acctbal")), f"{_SUP} UNION ALL SELECT i, 'bulk', 0, CAST(i AS DOUBLE) FROM range(900001, 901001) t(i)")


def _set(cond: str, name: str = "s_name", acctbal: str = "s_acctbal") -> str:
    return f"SELECT s_suppkey, CASE WHEN {cond} THEN {name} ELSE s_name END AS s_name, s_nationkey, CASE WHEN {cond} THEN {acctbal} ELSE s_acctbal END AS s_acctbal FROM supplier"


_state("update", lambda c: c.supplier.update(where={"s_suppkey": 7}, data={"s_name": "Seven", "s_acctbal": 0.25}), _set("s_suppkey = 7", "'Seven'", "0.25"))
_state("update_many", lambda c: c.supplier.update_many(where={"s_acctbal": {"lt": 0}}, data={"s_acctbal": 0.0}), _set("s_acctbal < 0", acctbal="0.0"))
_state("update_many_relation_where", lambda c: c.supplier.update_many(where={"nation": {"is": {"n_regionkey": 1}}}, data={"s_name": "one"}), _set("s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)", "'one'"))
_state("update_many_no_where", lambda c: c.supplier.update_many(data={"s_acctbal": 0.0}), _SUP)
_state("update_each", lambda c: c.supplier.update_each(by="s_suppkey", data=[{"s_suppkey": 1, "s_name": "a"}, {"s_suppkey": 2, "s_name": "b"}, {"s_suppkey": -5, "s_name": "c"}]), _set("s_suppkey IN (1, 2)", "CASE s_suppkey WHEN 1 THEN 'a' ELSE 'b' END"))
_state("update_each_where", lambda c: c.supplier.update_each(by="s_suppkey", data=[{"s_suppkey": i, "s_name": "x"} for i in range(1, 30)], where={"s_acctbal": {"gt": 0}}), _set("s_suppkey BETWEEN 1 AND 29 AND s_acctbal > 0", "'x'"))
_state("delete", lambda c: c.supplier.delete(where={"s_suppkey": 7}), f"{_SUP} WHERE s_suppkey <> 7")
_state("delete_many", lambda c: c.supplier.delete_many(where={"s_acctbal": {"lt": 0}}), f"{_SUP} WHERE NOT (s_acctbal < 0)")
_state("delete_many_no_where", lambda c: c.supplier.delete_many(), _SUP)
_state("upsert_insert", lambda c: c.supplier.upsert(where={"s_suppkey": 900001}, create=_ROW, update={"s_name": "never"}), f"{_SUP} UNION ALL SELECT 900001, 'New', 3, 1.5")
_state("upsert_update", lambda c: c.supplier.upsert(where={"s_suppkey": 7}, create=_ROW, update={"s_name": "Seven"}), _set("s_suppkey = 7", "'Seven'"))
_UP = [_ROW, _ROW | {"s_suppkey": 7, "s_name": "Seven", "s_acctbal": 9.0}]
_NEW = " UNION ALL SELECT 900001, 'New', 3, 1.5"
_state("upsert_many_all", lambda c: c.supplier.upsert_many(data=_UP, target="s_suppkey", update="all"), f"SELECT s_suppkey, CASE WHEN s_suppkey = 7 THEN 'Seven' ELSE s_name END AS s_name, CASE WHEN s_suppkey = 7 THEN 3 ELSE s_nationkey END AS s_nationkey, CASE WHEN s_suppkey = 7 THEN 9.0 ELSE s_acctbal END AS s_acctbal FROM supplier{_NEW}")
_state("upsert_many_columns", lambda c: c.supplier.upsert_many(data=_UP, target="s_suppkey", update=["s_name"]), _set("s_suppkey = 7", "'Seven'") + _NEW)
_state("upsert_many_object", lambda c: c.supplier.upsert_many(data=_UP, target="s_suppkey", update={"s_acctbal": 5.0}), _set("s_suppkey = 7", acctbal="5.0") + _NEW)
_state("upsert_many_callback", lambda c: c.supplier.upsert_many(data=_UP, target="s_suppkey", update=lambda x: {"s_acctbal": x["excluded"]["s_acctbal"] + x["table"]["s_acctbal"]}), _set("s_suppkey = 7", acctbal="9.0 + s_acctbal") + _NEW)
_state("upsert_many_where", lambda c: c.supplier.upsert_many(data=_UP, target="s_suppkey", update=["s_name"], where={"s_nationkey": -1}), _SUP + _NEW)

# 2.9 relation writes

_ORD = "SELECT o_orderkey, {} AS o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders"
_state("rel_connect", lambda c: c.customer.update(where={"c_custkey": 3}, data={"orders": {"connect": [{"o_orderkey": 1}, {"o_orderkey": 2}]}}), _ORD.format("CASE WHEN o_orderkey IN (1, 2) THEN 3 ELSE o_custkey END"), "orders")
_state("rel_connect_owning", lambda c: c.orders.update(where={"o_orderkey": 1}, data={"customer": {"connect": {"c_custkey": 3}}}), _ORD.format("CASE WHEN o_orderkey = 1 THEN 3 ELSE o_custkey END"), "orders")
_state("rel_disconnect", lambda c: c.orders.update(where={"o_orderkey": 1}, data={"customer": {"disconnect": True}}), _ORD.format("CASE WHEN o_orderkey = 1 THEN NULL ELSE o_custkey END"), "orders")
_state("rel_set", lambda c: c.customer.update(where={"c_custkey": 3}, data={"orders": {"set": [{"o_orderkey": 1}]}}), _ORD.format("CASE WHEN o_orderkey = 1 THEN 3 WHEN o_custkey = 3 THEN NULL ELSE o_custkey END"), "orders")
_PS = "SELECT DISTINCT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey FROM lineitem"
_state("m2m_connect", lambda c: c.part.update(where={"p_partkey": 1}, data={"supplier": {"connect": [{"s_suppkey": 1}, {"s_suppkey": 2}]}}), f"{_PS} UNION SELECT 1, unnest([1, 2])", "part_supplier")
_state("m2m_disconnect", lambda c: c.part.update(where={"p_partkey": 1}, data={"supplier": {"disconnect": True}}), f"{_PS} WHERE l_partkey <> 1", "part_supplier")
_state("m2m_set", lambda c: c.part.update(where={"p_partkey": 1}, data={"supplier": {"set": [{"s_suppkey": 5}]}}), f"{_PS} WHERE l_partkey <> 1 UNION ALL SELECT 1, 5", "part_supplier")

# 2.10 transactions


def _commit(c: Client) -> None:
    def work(tx: Client) -> None:
        tx.supplier.create(data=_ROW)
        tx.supplier.update(where={"s_suppkey": 7}, data={"s_name": "Seven"})

    c.transaction(work)


def _rolled_back(c: Client) -> None:
    def work(tx: Client) -> None:
        tx.supplier.create(data=_ROW)
        tx.rollback("no")

    try:
        c.transaction(work)
    except Exception as e:
        if getattr(e, "status", None) != 409:
            raise


def _savepoint(c: Client) -> None:
    def work(tx: Client) -> None:
        tx.supplier.create(data=_ROW)
        _rolled_back(tx)
        tx.supplier.update(where={"s_suppkey": 7}, data={"s_name": "Seven"})

    c.transaction(work)


_state("tx_commit", _commit, _set("s_suppkey = 7", "'Seven'") + _NEW)
_state("tx_rollback", _rolled_back, _SUP)
_state("tx_savepoint", _savepoint, _set("s_suppkey = 7", "'Seven'") + _NEW)


# 2.13 plugins

_AT = datetime(2024, 1, 1, 12)
_NOTES = Schema({"notes": Table({"id": Column("bigint", "s_suppkey", nullable=False), "name": Column("string", "s_name"), "deletedAt": Column("timestamp_ntz"), "createdAt": Column("timestamp_ntz"), "updatedAt": Column("timestamp_ntz")}, ("id",))})


def _notes(name: str, work: Callable[[Client], DataFrame], sql: str) -> None:
    """Over suppliers whose nation is even as rows that were deleted before."""

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr("s_suppkey", "s_name", "CASE WHEN s_nationkey % 2 = 0 THEN TIMESTAMP_NTZ '2020-01-01 00:00:00' END AS deletedAt", "CAST(NULL AS TIMESTAMP_NTZ) AS createdAt", "CAST(NULL AS TIMESTAMP_NTZ) AS updatedAt")
        clock = lambda: _AT
        return work(Client.open(spark, _NOTES, {"notes": rows}, plugins=[soft_delete(clock=clock), timestamps(clock=clock)]))

    QUERIES[name], ORACLES[name] = build, sql


_ids = {"id": True}
_notes("where_null", lambda c: c.without_plugins().notes.find_many(where={"deletedAt": None}, select=_ids).df, "SELECT s_suppkey AS id FROM supplier WHERE s_nationkey % 2 <> 0")
_notes("soft_delete_read", lambda c: c.notes.find_many(select=_ids).df, "SELECT s_suppkey AS id FROM supplier WHERE s_nationkey % 2 <> 0")
_notes("soft_delete_only", lambda c: c.notes.find_many(select=_ids, deleted="only").df, "SELECT s_suppkey AS id FROM supplier WHERE s_nationkey % 2 = 0")
_notes("soft_delete_with", lambda c: c.notes.find_many(select=_ids, deleted="with").df, "SELECT s_suppkey AS id FROM supplier")
_notes("soft_delete_count", lambda c: c.notes.count().df, "SELECT count(*) AS count FROM supplier WHERE s_nationkey % 2 <> 0")


def _after(work: Callable[[Client], object]) -> Callable[[Client], DataFrame]:
    return lambda c: (work(c), c.notes.find_many(deleted="with").df)[1]


_STATE = "SELECT s_suppkey AS id, {name} AS name, {deleted} AS deletedAt, {created} AS createdAt, {updated} AS updatedAt FROM supplier"
_plain = {"name": "s_name", "deleted": "CASE WHEN s_nationkey % 2 = 0 THEN TIMESTAMP '2020-01-01 00:00:00' END", "created": "CAST(NULL AS TIMESTAMP)", "updated": "CAST(NULL AS TIMESTAMP)"}
_now = "TIMESTAMP '2024-01-01 12:00:00'"
_notes("soft_delete_write", _after(lambda c: [c.notes.delete(where={"id": i}) for i in (1, 2, 3)]), _STATE.format(**_plain | {"deleted": f"CASE WHEN s_nationkey % 2 = 0 THEN TIMESTAMP '2020-01-01 00:00:00' WHEN s_suppkey IN (1, 2, 3) THEN {_now} END"}))
_notes("hard_delete", _after(lambda c: c.notes.delete(where={"id": 1}, mode="hard")), _STATE.format(**_plain) + " WHERE s_suppkey <> 1")
_notes("restore", _after(lambda c: c.notes.restore({"id": {"lt": 20}})), _STATE.format(**_plain | {"deleted": "CASE WHEN s_nationkey % 2 = 0 AND NOT (s_suppkey < 20) THEN TIMESTAMP '2020-01-01 00:00:00' END"}))
_notes("timestamps_update", _after(lambda c: c.notes.update_many(where={"id": {"lt": 10}}, data={"name": "x"})), _STATE.format(**_plain | {"name": "CASE WHEN s_suppkey < 10 THEN 'x' ELSE s_name END", "updated": f"CASE WHEN s_suppkey < 10 THEN {_now} END"}))
_notes("timestamps_create", _after(lambda c: c.notes.create(data={"id": 900001, "name": "New"})), _STATE.format(**_plain) + f" UNION ALL SELECT 900001, 'New', NULL, {_now}, {_now}")

# 2.11 raw SQL

add("raw_named", lambda c: c.raw_frame("SELECT o_orderkey FROM orders WHERE o_orderstatus = :s AND o_totalprice > :p", {"s": "F", "p": 100000.0}), "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
add("raw_positional", lambda c: c.raw_frame("SELECT o_orderkey FROM orders WHERE o_orderstatus = ? AND o_totalprice > ?", ["F", 100000.0]), "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
_state("execute_raw_update", lambda c: c.execute_raw("UPDATE supplier SET s_name = :n, s_acctbal = s_acctbal + 1 WHERE s_suppkey < :k", {"n": "raw", "k": 10}), _set("s_suppkey < 10", "'raw'", "s_acctbal + 1"))
_state("execute_raw_insert", lambda c: c.execute_raw("INSERT INTO supplier (s_suppkey, s_name) SELECT s_suppkey + 1000000, upper(s_name) FROM supplier WHERE s_acctbal < 0"), f"{_SUP} UNION ALL SELECT s_suppkey + 1000000, upper(s_name), NULL, NULL FROM supplier WHERE s_acctbal < 0")
_state("execute_raw_delete", lambda c: c.execute_raw("DELETE FROM supplier WHERE s_acctbal < 0"), f"{_SUP} WHERE NOT (s_acctbal < 0)")

# the flagship: orders of one market segment, the dearest first, with their customers


def flagship(c: Client) -> DataFrame:
    found = c.orders.find_many(
        where={"o_totalprice": {"gte": 100000}, "customer": {"is": {"c_mktsegment": "BUILDING"}}},
        include={"customer": True},
        orderBy=_by,
        take=40,
    )
    return found.df.select("o_orderkey", "o_totalprice", "customer.c_custkey", "customer.c_name")


add("flagship", flagship, "SELECT o_orderkey, o_totalprice, c_custkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice >= 100000 AND c_mktsegment = 'BUILDING' ORDER BY o_totalprice DESC, o_orderkey LIMIT 40")


# 2.3 JSON documents of several types and shapes

_DOC = """CASE user_id % 4 WHEN 0 THEN '{"k": null}' WHEN 1 THEN concat('{"s": "', event_type, '", "o": {"n": ', user_id, '.5, "b": ', user_id % 3 = 0, '}}') WHEN 2 THEN 'no json' ELSE props END"""


def _json(name: str, paths: dict, sql: str) -> None:
    """Events with documents that hold nulls, strings and objects."""

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("* EXCEPT (props)", f"{_DOC} AS props")
        c = Client.open(spark, domain_schema(), {"events": rows})
        return c.events.find_many(where={"props": {"json": paths}}, select={"event_id": True}).df

    QUERIES[name], ORACLES[name] = build, f"SELECT event_id FROM events WHERE {sql}"


_json("json_null", {"k": None}, "user_id % 4 = 0")
_json("json_contains", {"s": {"contains": "i"}}, "user_id % 4 = 1 AND event_type LIKE '%i%'")
_json("json_starts_with", {"s": {"startsWith": "c"}}, "user_id % 4 = 1 AND event_type LIKE 'c%'")
_json("json_ends_with", {"s": {"endsWith": "w"}}, "user_id % 4 = 1 AND event_type LIKE '%w'")
_json("json_string", {"s": "click"}, "user_id % 4 = 1 AND event_type = 'click'")
_json("json_boolean", {"o.b": True}, "user_id % 4 = 1 AND user_id % 3 = 0")
_json("json_several_paths", {"o.n": {"gt": 20, "lte": 40.5}, "s": {"in": ["view", "click"]}}, "user_id % 4 = 1 AND user_id + 0.5 > 20 AND user_id + 0.5 <= 40.5 AND event_type IN ('view', 'click')")
_json("json_type_mismatch", {"o.n": {"not": "20.5"}, "s": {"not": 7}}, "user_id % 4 = 1")
_json("json_no_condition", {"o.n": {"gt": "20"}, "s": {"not": "view"}}, "user_id % 4 = 1 AND event_type <> 'view'")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


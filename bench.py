"""Headline query shapes at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line of seconds by query."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from graphlake.domain import client
from graphlake.queries import flagship

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
REPEATS = 3
F_ORDERS = {"o_orderstatus": "F"}
BY = [{"o_totalprice": "desc"}, {"o_orderkey": "asc"}]


def _read_only(c):
    return c.transaction(lambda tx: [tx.orders.count(where=F_ORDERS).value(), tx.customer.exists(where={"c_custkey": 5}).value()])


def _transaction(c):
    def work(tx):
        tx.supplier.create(data={"s_suppkey": 900001, "s_name": "n"})
        tx.supplier.update(where={"s_suppkey": 900001}, data={"s_name": "m"})

    return c.transaction(work)


def _nested(c):
    def work(tx):
        tx.supplier.create(data={"s_suppkey": 900001, "s_name": "n"})
        tx.transaction(lambda inner: inner.supplier.create(data={"s_suppkey": 900002, "s_name": "n"}))

    return c.transaction(work)


def _full(df):
    """Every column computed, nothing brought to the driver."""
    df.write.format("noop").mode("overwrite").save()


#: name -> what runs with a client whose tables are as loaded
SHAPES = {
    "point_lookup": lambda c: c.orders.find_unique(where={"o_orderkey": 7}).value(),
    "filtered_list": lambda c: c.orders.find_many(where=F_ORDERS, orderBy=BY, take=50).value(),
    "active_count": lambda c: c.orders.count(where=F_ORDERS).value(),
    "exists": lambda c: c.orders.exists(where=F_ORDERS).value(),
    "offset_pagination": lambda c: c.orders.paginate(where=F_ORDERS, orderBy=BY, limit=20, skip=40).value(),
    "cursor_pagination": lambda c: c.orders.cursor(orderBy={"o_orderkey": "asc"}, limit=20, cursor={"after": {"o_orderkey": 100}}).value(),
    "complex_relation_filter": lambda c: flagship(c).collect(),
    "relation_graph": lambda c: _full(c.customer.find_many(include={"nation": True, "orders": {"orderBy": {"o_totalprice": "desc"}, "take": 3, "include": {"lineitems": {"take": 2}}}}).df),
    "relation_counts": lambda c: _full(c.customer.find_many(include={"_count": {"select": {"orders": {"where": F_ORDERS}}}}).df),
    "nested_relation_page": lambda c: _full(c.customer.find_many(include={"orders": {"orderBy": {"o_totalprice": "desc"}, "take": 2, "skip": 1}}).df),
    "relation_quantifiers": lambda c: _full(c.customer.find_many(where={"orders": {"some": {"o_totalprice": {"gt": 250000}}, "none": {"o_orderstatus": "P"}}}).df),
    "m2m_filter": lambda c: _full(c.part.find_many(where={"supplier": {"some": {"s_acctbal": {"lt": 0}}}}).df),
    "json_path_filter": lambda c: _full(c.events.find_many(where={"props": {"json": {"k": {"gte": 20, "lt": 40}}}}).df),
    "raw_sql": lambda c: c.raw("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > :p GROUP BY 1", {"p": 100000.0}),
    "update_reload": lambda c: c.supplier.update(where={"s_suppkey": 7}, data={"s_name": "x"}),
    "update_many": lambda c: c.supplier.update_many(where={"s_acctbal": {"lt": 0}}, data={"s_acctbal": 0.0}),
    "update_each": lambda c: c.supplier.update_each(by="s_suppkey", data=[{"s_suppkey": i, "s_name": "x"} for i in range(1, 200)]),
    "upsert_many": lambda c: c.supplier.upsert_many(data=[{"s_suppkey": i, "s_name": "x"} for i in range(900, 1100)], target="s_suppkey"),
    "simple_transaction": _transaction,
    "read_only_transaction": _read_only,
    "nested_transaction": _nested,
}


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    client(spark, SF_DIR).orders.count().value()  # the JVM's start is nobody's query
    took = {}
    for name, run in SHAPES.items():
        best = None
        for _ in range(REPEATS):
            c = client(spark, SF_DIR)
            began = time.perf_counter()
            run(c)
            spent = time.perf_counter() - began
            best = spent if best is None else min(best, spent)
        took[name] = round(best, 4)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF_DIR.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()

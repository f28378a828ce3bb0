"""The test tables as a declared schema, and clients over a folder of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphlake.client import Client
from graphlake.schema import Column, Schema, Table, many, one

_S, _I, _L, _D, _T = "string", "int", "bigint", "double", "timestamp_ntz"


def _table(key: str | tuple[str, ...], **columns: str) -> Table:
    key = (key,) if isinstance(key, str) else key
    return Table({k: Column(t, nullable=k not in key) for k, t in columns.items()}, primary_key=tuple(k for k in key if k))


def schema() -> Schema:
    """lineitem has no key: (l_orderkey, l_linenumber) repeats. part and supplier meet in part_supplier."""
    return Schema(
        {
            "region": _table("r_regionkey", r_regionkey=_I, r_name=_S),
            "nation": _table("n_nationkey", n_nationkey=_I, n_name=_S, n_regionkey=_I),
            "customer": _table("c_custkey", c_custkey=_L, c_name=_S, c_nationkey=_I, c_acctbal=_D, c_mktsegment=_S),
            "supplier": _table("s_suppkey", s_suppkey=_L, s_name=_S, s_nationkey=_I, s_acctbal=_D),
            "part": _table("p_partkey", p_partkey=_L, p_name=_S, p_brand=_S, p_type=_S, p_size=_I, p_retailprice=_D),
            "orders": _table("o_orderkey", o_orderkey=_L, o_custkey=_L, o_orderstatus=_S, o_totalprice=_D, o_orderdate=_T, o_orderpriority=_S),
            "lineitem": _table((), l_orderkey=_L, l_partkey=_L, l_suppkey=_L, l_linenumber=_I, l_quantity=_D, l_extendedprice=_D, l_discount=_D, l_tax=_D, l_returnflag=_S, l_linestatus=_S, l_shipdate=_T),
            "events": _table("event_id", event_id=_L, ts=_T, user_id=_L, event_type=_S, value=_D, props=_S),
            "documents": _table("doc_id", doc_id=_L, lang=_S, source=_S, n_chars=_L),
            "labels": _table("doc_id", doc_id=_L, quality=_I, toxic=_I),
            "conversations": _table(("conv_id", "turn"), conv_id=_L, turn=_L, role=_S, text=_S),
            "part_supplier": _table(("ps_partkey", "ps_suppkey"), ps_partkey=_L, ps_suppkey=_L),
        },
        {
            "region": {"nations": many("nation", "r_regionkey", "n_regionkey")},
            "nation": {"region": one("region", "n_regionkey", "r_regionkey"), "customers": many("customer", "n_nationkey", "c_nationkey"), "suppliers": many("supplier", "n_nationkey", "s_nationkey")},
            "customer": {"nation": one("nation", "c_nationkey", "n_nationkey"), "orders": many("orders", "c_custkey", "o_custkey")},
            "supplier": {"nation": one("nation", "s_nationkey", "n_nationkey")},
            "orders": {"customer": one("customer", "o_custkey", "c_custkey"), "lineitems": many("lineitem", "o_orderkey", "l_orderkey")},
            "lineitem": {"order": one("orders", "l_orderkey", "o_orderkey"), "part": one("part", "l_partkey", "p_partkey"), "supplier": one("supplier", "l_suppkey", "s_suppkey")},
            "documents": {"label": one("labels", "doc_id", "doc_id", owning=False)},
            "labels": {"document": one("documents", "doc_id", "doc_id")},
            "part_supplier": {"part": one("part", "ps_partkey", "p_partkey"), "supplier": one("supplier", "ps_suppkey", "s_suppkey")},
        },
    )


def sources(spark: SparkSession, sf_dir: str) -> dict[str, str | DataFrame]:
    out: dict[str, str | DataFrame] = {n: f"{sf_dir}/{n}.parquet" for n in schema().tables if n != "part_supplier"}
    pairs = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("l_partkey AS ps_partkey", "l_suppkey AS ps_suppkey").distinct()
    return out | {"part_supplier": pairs}


def client(spark: SparkSession, sf_dir: str, **options) -> Client:
    return Client.open(spark, schema(), sources(spark, sf_dir), **options)

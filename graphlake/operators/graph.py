"""Projections and relation graphs, assembled bottom-up as struct and array columns.

One join per relation path: children are filtered, ranked within their parent, grouped by the link and joined
to it. Where the parents are few (filtered or limited), children that belong to none of them are dropped by a
semi join before they are grouped.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphlake.errors import EngineError, ErrorCode, fail
from graphlake.operators.order import cursor_condition, order_entries, sort_columns, with_key
from graphlake.operators.where import WhereCompiler, all_of
from graphlake.schema import Relation, Table
from graphlake.values import UNSET, given


class Selection:
    """What a level shows: columns, relations with their arguments, counts."""

    def __init__(self, schema, table: Table, args: dict):
        select, include = (args.get(k) if args.get(k) not in (None, UNSET) else None for k in ("select", "include"))
        if select is not None and include is not None:
            raise fail("select and include can't be used at one level")
        self.relations: dict[str, dict] = {}
        self.counts: dict[str, Any] = {}
        chosen = []
        for key, value in given(select if select is not None else include or {}).items():
            if key == "_count" and include is not None:
                self.counts = self._counts(schema, table, value)
            elif key in table.relations or key in table.ambiguous:
                schema.relation(table, key)
                if value not in (False, None):
                    self.relations[key] = {} if value is True else value
            elif select is not None and key in table.columns:
                if value is True:
                    chosen.append(key)
            else:
                raise fail(f'Unknown key "{key}" in {"select" if select is not None else "include"} of {table.name}')
        self.columns = chosen if chosen or (select is not None and self.relations) else list(table.columns)

    @staticmethod
    def _counts(schema, table: Table, value: Any) -> dict[str, Any]:
        if not isinstance(value, dict) or set(value) != {"select"} or not given(value["select"]):
            raise fail("_count takes a select of at least one relation")
        out = {}
        for rel, arg in given(value["select"]).items():
            schema.relation(table, rel)
            if isinstance(arg, dict) and set(arg) - {"where"}:
                raise fail(f'_count of "{rel}" takes only where')
            if arg:
                out[rel] = arg.get("where") if isinstance(arg, dict) else None
        return out


class GraphBuilder:
    def __init__(self, schema, scan, compiler: WhereCompiler, lenient: bool = False):
        self.schema, self.scan, self.compiler, self.lenient = schema, scan, compiler, lenient

    def project(self, table: Table, df: DataFrame, args: dict, *, few: bool, keep: tuple[str, ...] = ()) -> DataFrame:
        """``df`` (all columns of ``table``, and those of ``keep``) with the columns and relations asked for."""
        chosen = Selection(self.schema, table, args)
        for name, nested in chosen.relations.items():
            df = self._include(table, self.schema.relation(table, name), nested, df, few)
        if chosen.counts:
            for name, where in chosen.counts.items():
                df = self._count(self.schema.relation(table, name), where, df, few)
            df = df.withColumn("_count", F.struct(*(F.coalesce(F.col(f"__n_{n}"), F.lit(0).cast("long")).alias(n) for n in chosen.counts)))
        shown = chosen.columns + [f"__r_{n}" for n in chosen.relations]
        return df.select(*(F.col(c).alias(c.removeprefix("__r_")) for c in shown), *(["_count"] if chosen.counts else []), *keep)

    def _children(self, rel: Relation, args: dict, parents: DataFrame | None) -> tuple[DataFrame, list[str]]:
        """The target's rows with the columns __k0, ... that hold the parent's key."""
        target = self.schema.table(rel.target)
        rows = self.compiler.apply(target, self.scan(rel.target), args.get("where"))
        keys = [f"__k{i}" for i in range(len(rel.fields))]
        if rel.through:
            j = self.scan(rel.through).select(*(F.col(c).alias(k) for k, c in zip(keys, rel.through_fields)), *(F.col(c).alias(f"__j{i}") for i, c in enumerate(rel.through_references)))
            rows = rows.join(j, all_of(F.col(f"__j{i}") == F.col(c) for i, c in enumerate(rel.references)))
            rows = rows.drop(*(f"__j{i}" for i in range(len(rel.references))))
        else:
            rows = rows.select("*", *(F.col(c).alias(k) for k, c in zip(keys, rel.references)))
        if parents is not None:
            wanted = parents.select(*(F.col(c).alias(f"__p{i}") for i, c in enumerate(rel.fields))).distinct()
            rows = rows.join(wanted, all_of(F.col(k) == F.col(f"__p{i}") for i, k in enumerate(keys)), "left_semi")
        return rows, keys

    def _include(self, table: Table, rel: Relation, args: dict, df: DataFrame, few: bool) -> DataFrame:
        if args.get("lock") not in (None, UNSET):
            raise EngineError(ErrorCode.LOCK_NOT_SUPPORTED, f'lock is not supported in the nested relation "{rel.name}"')
        target = self.schema.table(rel.target)
        rows, keys = self._children(rel, args, df if few else None)
        entries = order_entries(target, args.get("orderBy"), self.lenient)
        beyond = cursor_condition(args.get("cursor"), entries, args.get("take"))
        if beyond is not None:
            rows = rows.where(beyond)
        take, skip = (args[k] if isinstance(args.get(k), int) else None for k in ("take", "skip"))
        skip = max(skip or 0, 0)
        if rel.kind == "one":
            take = 1 if take is None else min(abs(take), 1)
        ranked = rel.kind == "many" or target.primary_key != rel.references
        if ranked:
            w = Window.partitionBy(*keys).orderBy(*sort_columns(with_key(target, entries)))
            rows = rows.withColumn("__rn", F.row_number().over(w))
            if take is not None:  # a literal bound, from which Spark derives a limit within each group
                rows = rows.where(f"__rn <= {skip + abs(take)}")
            if skip:
                rows = rows.where(f"__rn > {skip}")
        kept = (*keys, "__rn") if ranked else tuple(keys)
        rows = self.project(target, rows, args, few=few, keep=kept)
        shown = [c for c in rows.columns if c not in kept]
        right = [f"__l{i}" for i in range(len(keys))]
        value = f"__r_{rel.name}"
        if rel.kind == "one":
            child = rows.select(*(F.col(k).alias(r) for k, r in zip(keys, right)), F.struct(*shown).alias(value))
        else:
            each = F.collect_list(F.struct("__rn", F.struct(*shown).alias("row")))
            child = rows.groupBy(*(F.col(k).alias(r) for k, r in zip(keys, right))).agg(F.transform(F.array_sort(each), lambda x: x["row"]).alias(value))
        out = df.join(child, all_of(F.col(a) == F.col(r) for a, r in zip(rel.fields, right)), "left").drop(*right)
        if rel.kind == "many":
            out = out.withColumn(value, F.coalesce(F.col(value), F.array().cast(child.schema[value].dataType)))
        return out

    def _count(self, rel: Relation, where: Any, df: DataFrame, few: bool) -> DataFrame:
        rows, keys = self._children(rel, {"where": where}, df if few else None)
        n = f"__n_{rel.name}"
        right = [f"__c{i}" for i in range(len(keys))]
        counts = rows.groupBy(*(F.col(k).alias(r) for k, r in zip(keys, right))).agg(F.count("*").alias(n))
        return df.join(counts, all_of(F.col(a) == F.col(r) for a, r in zip(rel.fields, right)), "left").drop(*right)


def deferred_relations(schema, table: Table, args: dict, path: str = "") -> list[dict]:
    """What explain() says of the relations of a request."""
    out = []
    source = args.get("include") or args.get("select") or {}
    for key, value in given(source).items():
        if key not in table.relations or not value:
            continue
        rel, nested = schema.relation(table, key), value if isinstance(value, dict) else {}
        at = f"{path}.{key}" if path else key
        out.append({"path": at, "table": rel.target, "cardinality": rel.kind, "filtered": bool(nested.get("where")), "sorted": bool(nested.get("orderBy")), "paginated": any(nested.get(k) is not None for k in ("take", "skip", "cursor")), "through": rel.through})
        out += deferred_relations(schema, schema.table(rel.target), nested, at)
    return out

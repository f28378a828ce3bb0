"""Soft delete: deletions mark rows, reads leave marked rows out."""

from __future__ import annotations

from datetime import datetime, timezone
from typing import Any

from graphlake.errors import fail
from graphlake.hooks import Operation, Plugin, Skip
from graphlake.values import UNSET

READS = ("findMany", "findFirst", "count", "exists")
ALL_READS = (*READS, "findOne", "findUnique", "paginate", "cursor")


def soft_delete(*, column: str = "deletedAt", by_column: str | None = "deletedById", mode: str = "soft", models: tuple[str, ...] | None = None, clock=None, strict: bool = False) -> Plugin:
    """Reads take ``deleted``: without (the default), with or only; delete takes ``mode`` (soft or hard) and
    ``deletedBy``. Models without the column are left alone. ``strict`` covers every kind of read and
    deleteMany too; by default findMany, findFirst, count, exists and delete are covered. Models get
    restore(where) and restore_by_id(id)."""
    clock = clock or (lambda: datetime.now(timezone.utc).replace(tzinfo=None))

    def covers(client: Any, model: str | None) -> bool:
        return model is not None and column in client.schema.table(model).columns and (models is None or model in models)

    def mark(op: Operation, deleted: bool) -> dict:
        data: dict[str, Any] = {column: clock() if deleted else None}
        if by_column and by_column in op.client.schema.table(op.model).columns:
            data[by_column] = op.args.get("deletedBy", op.meta.get("deletedBy")) if deleted else None
        return data

    def before_delete(op: Operation) -> Any:
        if not covers(op.client, op.model) or op.kind == "deleteMany" and not strict:
            return None
        if (op.args.get("mode") or mode) == "hard":
            return None
        where = op.args.get("where")
        if where in (None, UNSET) or where == {}:
            return None
        own = op.client.without_plugins()[op.model]
        visible = {"AND": [where, {column: None}]}
        if op.kind == "deleteMany":
            raise Skip(own.update_many({"where": visible, "data": mark(op, True)}))
        shape = {k: op.args[k] for k in ("select", "include") if k in op.args}
        raise Skip(own.update({"where": visible, "data": mark(op, True), **shape}))

    def transform(op: Operation) -> dict | None:
        if op.kind not in (ALL_READS if strict else READS) or not covers(op.client, op.model):
            return None
        args = dict(op.args)
        shown = args.pop("deleted", None) or op.state.get("deleted") or "without"
        if shown == "with":
            return args
        if shown not in ("without", "only"):
            raise fail(f'deleted is "without", "with" or "only", not "{shown}"')
        extra = {column: None} if shown == "without" else {column: {"not": None}}
        where = args.get("where")
        args["where"] = {"AND": [where, extra]} if where not in (None, UNSET) else extra
        return args

    def extend(client: Any, table: Any) -> dict:
        if not covers(client, table.name):
            return {}

        def restore(where: dict) -> dict:
            blank = {column: None} | ({by_column: None} if by_column and by_column in table.columns else {})
            return client.without_plugins()[table.name].update_many({"where": {"AND": [where, {column: {"not": None}}]}, "data": blank})

        def restore_by_id(value: Any) -> dict | None:
            key = table.primary_key[0]
            restore({key: value})
            return client.without_plugins()[table.name].find_first({"where": {key: value}}).value()

        return {"restore": restore, "restore_by_id": restore_by_id}

    return Plugin(
        "soft-delete",
        operation_args={**dict.fromkeys(ALL_READS, ("deleted",)), "delete": ("mode", "deletedBy"), "deleteMany": ("mode", "deletedBy")},
        hooks={"beforeDelete": before_delete},
        transform=transform,
        extend_model=extend,
    )

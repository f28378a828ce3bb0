"""Timestamps: one clock value an operation for createdAt and updatedAt."""

from __future__ import annotations

from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlake.hooks import Operation, Plugin

WRITES = ("create", "createMany", "upsert", "upsertMany", "update", "updateMany", "updateEach")


def timestamps(*, created: str = "createdAt", updated: str = "updatedAt", mode: str = "app", models: tuple[str, ...] | None = None, clock=None) -> Plugin:
    """Columns that a model lacks are left out; values that the data gives are kept. ``mode="database"`` leaves
    it to column defaults. An upsertMany never touches the creation time of a row that is there."""
    clock = clock or (lambda: datetime.now(timezone.utc).replace(tzinfo=None))

    def transform(op: Operation) -> dict | None:
        if mode != "app" or op.kind not in WRITES or (models is not None and op.model not in models):
            return None
        columns = op.client.schema.table(op.model).columns
        now = clock()
        new = {c: now for c in (created, updated) if c in columns}
        touch = {updated: now} if updated in columns else {}
        if not new:
            return None

        def fill(data: Any, values: dict) -> Any:
            if isinstance(data, DataFrame):
                return data.withColumns({c: F.lit(v) for c, v in values.items() if c not in data.columns})
            if isinstance(data, (list, tuple)):
                return [{**values, **r} for r in data]
            return {**values, **(data or {})}

        args = dict(op.args)
        if op.kind in ("create", "createMany"):
            args["data"] = fill(args.get("data"), new)
        elif op.kind in ("update", "updateMany"):
            if args.get("data"):
                args["data"] = fill(args["data"], touch)
        elif op.kind == "upsert":
            args["create"] = fill(args.get("create"), new)
            if args.get("update"):
                args["update"] = fill(args["update"], touch)
        elif op.kind == "updateEach":
            update = args.get("update")
            if callable(update):
                args["update"] = lambda row: None if (got := update(row)) is None else {**touch, **got}
            else:
                args["data"] = fill(args.get("data") or [], touch)
                if isinstance(update, (list, tuple)) and touch:
                    args["update"] = [*update, *(c for c in touch if c not in update)]
        elif op.kind == "upsertMany":
            args["data"] = fill(args.get("data") or [], new)
            update = args.get("update", "all")
            target = args.get("target")
            target = {target} if isinstance(target, str) else set(target or op.client.schema.table(op.model).primary_key)
            if update == "all":
                args["update"] = [c for c in columns if c not in target and c != created]
            elif isinstance(update, (list, tuple)):
                args["update"] = [c for c in update if c != created] + [c for c in touch if c not in update]
            elif isinstance(update, dict):
                args["update"] = {**touch, **{k: v for k, v in update.items() if k != created}}
            elif callable(update):
                args["update"] = lambda ctx: {**touch, **{k: v for k, v in update(ctx).items() if k != created}}
        return args

    return Plugin("timestamps", transform=transform)

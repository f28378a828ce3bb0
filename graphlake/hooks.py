"""Lifecycle hooks and plugins: the order in which they see an operation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from graphlake.errors import EngineError, ErrorCode
from graphlake.values import UNSET

#: Operation -> hook family. Upserts fire the create hooks.
FAMILY = {
    **dict.fromkeys(("create", "createMany", "upsert", "upsertMany"), "Create"),
    **dict.fromkeys(("update", "updateMany", "updateEach"), "Update"),
    **dict.fromkeys(("delete", "deleteMany"), "Delete"),
    **dict.fromkeys(("findMany", "findFirst", "findOne", "findUnique", "count", "exists", "paginate", "cursor"), "Query"),
}
#: The sixteen hook names (fixed values).
HOOKS = tuple(f"{when}{what}" for what in ("Create", "Update", "Delete", "Query", "Raw") for when in ("before", "after")) + (
    "beforeTransaction",
    "afterTransactionCommit",
    "afterTransactionRollback",
    "onError",
    "onRawError",
    "onTransactionError",
)


@dataclass
class Plugin:
    """``requires``: {"columns": [{"name", "optional", "models"}]}; ``transform(op)`` returns new args;
    ``extend_model(client, table)`` and ``extend_client(client)`` return names and functions."""

    id: str
    dialects: tuple[str, ...] | None = None
    requires: dict = field(default_factory=dict)
    operation_args: dict[str, tuple[str, ...]] = field(default_factory=dict)
    hooks: dict[str, Callable] = field(default_factory=dict)
    transform: Callable[[Operation], dict | None] | None = None
    setup: Callable[[Any], None] | None = None
    extend_model: Callable[[Any, Any], dict] | None = None
    extend_client: Callable[[Any], dict] | None = None


@dataclass
class Operation:
    """What hooks and plugins are given. ``client`` runs further operations in the same scope."""

    kind: str
    model: str | None
    args: dict
    meta: dict
    state: dict
    client: Any
    in_transaction: bool = False
    result: Any = None


def check_plugins(plugins: list[Plugin], schema, dialect: str = "spark") -> None:
    """Duplicate ids, dialects, required columns, argument names that two plugins claim."""
    seen: dict[str, str] = {}
    ids = set()
    for p in plugins:
        if p.id in ids:
            raise EngineError(ErrorCode.PLUGIN_DUPLICATE_ID, f'Plugin "{p.id}" is given twice')
        ids.add(p.id)
        if p.dialects is not None and dialect not in p.dialects:
            raise EngineError(ErrorCode.PLUGIN_DIALECT_UNSUPPORTED, f'Plugin "{p.id}" doesn\'t support {dialect}')
        for c in p.requires.get("columns", []):
            for model in c.get("models") or schema.tables:
                if not c.get("optional") and c["name"] not in schema.table(model).columns:
                    raise EngineError(ErrorCode.PLUGIN_REQUIRED_COLUMN_MISSING, f'Plugin "{p.id}" requires the column {model}.{c["name"]}')
        for kind, keys in p.operation_args.items():
            for key in keys:
                if (owner := seen.setdefault(f"{kind}.{key}", p.id)) != p.id:
                    raise EngineError(ErrorCode.PLUGIN_OPERATION_ARG_CONFLICT, f'Plugins "{owner}" and "{p.id}" both define the argument "{key}" of {kind}')


class Skip(Exception):
    """A before-hook answered for the operation."""

    def __init__(self, result: Any):
        self.result = result


def call_hook(hooks: dict[str, Callable], name: str, subject: Any, owner: str = "client") -> Any:
    """The hook's answer; its failure is a HOOK_ERROR, unless it raises one of the engine's errors."""
    hook = hooks.get(name)
    if hook is None:
        return None
    try:
        return hook(subject)
    except (EngineError, Skip):
        raise
    except Exception as e:
        raise EngineError(ErrorCode.HOOK_ERROR, f"{name} of {owner} failed: {e}", details={"stage": name, "owner": owner}, cause=e) from e


def _answered(op: Operation, answer: Any) -> None:
    """An answer of a before-hook replaces the data of writes, and the result of anything else."""
    if answer is None or answer is UNSET:
        return
    if FAMILY[op.kind] in ("Create", "Update"):
        key = "create" if op.kind == "upsert" else "data"
        op.args = op.args | {key: answer}
    else:
        raise Skip(answer)


def run_pipeline(op: Operation, plugins: list[Plugin], hooks: dict[str, Callable], run: Callable[[Operation], Any], lazy: bool) -> Any:
    """Plugin before-hooks, transforms, client before-hook, the operation, client after-hook, plugin after-hooks.

    A lazy operation's after-hooks run when its value is there: ``run`` is then given a function that does so.
    """
    family = FAMILY[op.kind]

    def after(value: Any) -> Any:
        op.result = value
        call_hook(hooks, f"after{family}", op)
        for p in plugins:
            call_hook(p.hooks, f"after{family}", op, p.id)
        return op.result

    try:
        for p in plugins:
            _answered(op, call_hook(p.hooks, f"before{family}", op, p.id))
        for p in plugins:
            if p.transform and (new := p.transform(op)) is not None:
                op.args = new
        _answered(op, call_hook(hooks, f"before{family}", op))
    except Skip as s:
        return after(s.result)
    return run(op, after) if lazy else after(run(op, None))

"""Guard rules: a table of checks on the arguments of an operation, with levels, model scopes and presets."""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

from graphlake.errors import EngineError, ErrorCode
from graphlake.hooks import Operation, Plugin
from graphlake.values import UNSET

#: Columns whose selection counts as sensitive (fixed values).
SENSITIVE = ("apiKey", "apiKeys", "password", "passwordHash", "secret", "secrets", "ssn", "token", "tokens")
#: First words of statements that change something (fixed values).
MUTATIONS = ("insert", "update", "delete", "merge", "replace", "truncate", "create", "alter", "drop", "grant", "revoke")

Finding = tuple[str, tuple[str, ...]]


@dataclass(frozen=True)
class Violation:
    rule: str
    level: str
    message: str
    path: tuple[str, ...]
    operation: str
    model: str | None
    meta: dict


class Request:
    """What rules look at."""

    def __init__(self, op: Operation):
        self.op, self.kind, self.model, self.args, self.meta = op, op.kind, op.model, op.args, op.meta

    def has(self, key: str) -> bool:
        return self.args.get(key, UNSET) is not UNSET

    def get(self, key: str) -> Any:
        v = self.args.get(key)
        return None if v is UNSET else v

    @property
    def raw(self) -> bool:
        return self.kind in ("raw", "rawUnsafe", "executeRaw")

    @property
    def limit(self) -> int | None:
        keys = ["limit", "take", *(["perPage"] if self.kind == "paginate" else ["first", "last"] if self.kind == "cursor" else [])]
        return next((v for k in keys if isinstance(v := self.args.get(k), (int, float)) and not isinstance(v, bool)), None)

    @property
    def ordered(self) -> bool:
        order = self.get("orderBy")
        return bool(order) if isinstance(order, (list, tuple)) else order is not None

    @property
    def order_columns(self) -> list[str]:
        order = self.get("orderBy")
        return [k for e in (order if isinstance(order, (list, tuple)) else [order]) if isinstance(e, dict) for k in e]

    @property
    def lock(self) -> dict | None:
        lock = self.get("lock")
        return lock if isinstance(lock, dict) else None

    def reason(self, key: str = "reason") -> Any:
        return self.args[key] if key in self.args else self.meta.get(key)

    @property
    def mutation_verb(self) -> str:
        text = re.sub(r"^\s*/\*.*?\*/", "", self.args.get("sql") or "", flags=re.S)
        return (text.split() or [""])[0].lower()

    def mutates(self, allowed: Any = None) -> bool:
        text = (self.args.get("sql") or "").strip().lower()
        return not any(text.startswith(a.lower()) for a in allowed or ()) and self.mutation_verb in MUTATIONS

    def include_shape(self, tree: Any = None, depth: int = 1) -> tuple[int, int]:
        """(depth, relations) of the includes; a nested select isn't followed."""
        if not isinstance(tree, dict):
            return 0, 0
        deepest, n = depth, 0
        for v in tree.values():
            if v in (False, None, UNSET):
                continue
            n += 1
            if isinstance(v, dict):
                d, m = self.include_shape(v.get("with", v.get("include")), depth + 1)
                deepest, n = max(deepest, d), n + m
        return deepest, n

    def selects_sensitive(self) -> list[str]:
        select = self.get("select")
        return [c for c in SENSITIVE if isinstance(select, dict) and select.get(c) is True]


RULES: dict[str, Callable[[Request, dict], Iterator[Finding]]] = {}


def rule(fn: Callable[[Request, dict], Iterator[Finding]]) -> Callable:
    head, *rest = fn.__name__.split("_")
    RULES[head + "".join(w.capitalize() for w in rest)] = fn
    return fn


def _needs_where(kind: str) -> Callable[[Request, dict], Iterator[Finding]]:
    def check(r: Request, o: dict) -> Iterator[Finding]:
        if r.kind == kind and not r.has("where"):
            yield f"{kind} needs a where", ("where",)

    return check


for _kind in ("deleteMany", "updateMany", "delete", "update"):
    RULES[f"no{_kind[0].upper()}{_kind[1:]}WithoutWhere"] = _needs_where(_kind)


def _kinds(r: Request, o: dict, key: str, default: tuple[str, ...] | None) -> bool:
    chosen = o.get(key, default)
    return chosen is None or r.kind in chosen or "raw" in chosen and r.kind in ("raw", "rawUnsafe")


@rule
def no_empty_where(r, o):
    where = r.args.get("where", UNSET)
    empty = o.get("treatUndefinedAsEmpty", True) if where is UNSET else isinstance(where, dict) and (not where or o.get("treatEmptyAndOrAsEmpty") and any(where.get(k) == [] for k in ("AND", "OR")))
    if _kinds(r, o, "operations", None) and empty:
        yield "where is empty", ("where",)


@rule
def no_unbounded_find_many(r, o):
    bounded = o.get("allowWithWhere") and r.has("where") or o.get("allowWithLimit") and r.limit is not None or o.get("allowWithTake") and isinstance(r.get("take"), int) or o.get("allowSmallStaticModels") and r.has("where")
    if r.kind == "findMany" and not bounded:
        yield "findMany needs a bound: where or a limit", ()


@rule
def require_explicit_limit(r, o):
    if _kinds(r, o, "operations", ("findMany",)) and r.limit is None:
        yield "a limit is required", ("limit",)


@rule
def max_limit(r, o):
    if _kinds(r, o, "applyTo", ("findMany", "paginate", "cursor")) and r.limit is not None and r.limit > o["value"]:
        yield f"the limit {r.limit} is above {o['value']}", ("limit",)


@rule
def require_order_by_for_limit(r, o):
    if r.limit is not None and not r.ordered:
        yield "a limit needs orderBy", ("orderBy",)


@rule
def require_order_by_for_pagination(r, o):
    if r.kind == "paginate" and not r.ordered:
        yield "paginate needs orderBy", ("orderBy",)


@rule
def require_order_by_for_cursor(r, o):
    if r.kind == "cursor" and not r.ordered:
        yield "cursor needs orderBy", ("orderBy",)


@rule
def require_stable_order_by_for_cursor(r, o):
    if r.kind == "cursor" and r.order_columns and o.get("requirePrimaryKeyInOrderBy"):
        key = r.op.client.schema.table(r.model).primary_key or ("id",)
        if not set(key) & set(r.order_columns):
            yield "cursor needs an order with the primary key", ("orderBy",)


@rule
def max_include_depth(r, o):
    if r.has("include") and (depth := r.include_shape(r.get("include"))[0]) > o["value"]:
        yield f"include is {depth} deep, above {o['value']}", ("include",)


@rule
def max_include_relations(r, o):
    if r.has("include") and (n := r.include_shape(r.get("include"))[1]) > o["value"]:
        yield f"include names {n} relations, above {o['value']}", ("include",)


@rule
def require_transaction_for_lock(r, o):
    if r.has("lock") and not r.op.in_transaction:
        yield "locks need a transaction", ("lock",)


@rule
def no_lock_with_include(r, o):
    if r.has("lock") and r.get("include"):
        yield "lock and include exclude each other", ("lock",)


@rule
def no_invalid_lock_combination(r, o):
    if r.lock and r.lock.get("skipLocked") and r.lock.get("noWait"):
        yield "skipLocked and noWait exclude each other", ("lock",)


@rule
def require_order_by_for_skip_locked(r, o):
    if r.lock and r.lock.get("skipLocked") and not r.ordered:
        yield "skipLocked needs orderBy", ("orderBy",)


@rule
def require_limit_for_skip_locked(r, o):
    if r.lock and r.lock.get("skipLocked") and r.limit is None:
        yield "skipLocked needs a limit", ("limit",)


@rule
def no_raw_unsafe(r, o):
    if r.kind == "rawUnsafe":
        yield "raw_unsafe is not allowed", ()


@rule
def require_raw_comment(r, o):
    if r.raw and len((r.args.get("comment") or "").strip()) < max(1, o.get("minLength", 1)):
        yield "raw SQL needs a comment", ("comment",)


@rule
def require_raw_timeout(r, o):
    timeout = r.args.get("timeoutMs")
    if r.raw and timeout is None:
        yield "raw SQL needs timeoutMs", ("timeoutMs",)
    for key in ("defaultTimeoutMs", "maxTimeoutMs"):
        if r.raw and timeout is not None and o.get(key) is not None and timeout > o[key]:
            yield f"timeoutMs {timeout} is above {key} {o[key]}", ("timeoutMs",)


@rule
def no_raw_mutation(r, o):
    if r.raw and r.mutates(o.get("allow")):
        yield "raw SQL may not change data", ()


@rule
def no_raw_without_transaction(r, o):
    if r.raw and not r.op.in_transaction and (not o.get("onlyMutations") or r.mutates()):
        yield "raw SQL needs a transaction", ()


@rule
def require_tenant_context(r, o):
    key = o.get("contextKey", "tenantId")
    if not (o.get("allowSystem") and r.meta.get("system")) and r.meta.get(key) is None:
        yield f"the context needs {key}", ("meta", key)


@rule
def no_tenant_bypass_without_system(r, o):
    key = o.get("systemContextKey", "system")
    if r.args.get("bypassTenant") and not r.meta.get(key):
        yield "bypassTenant needs the system context", ("meta", key)


@rule
def no_tenant_column_override(r, o):
    column = o.get("tenantColumn", "tenantId")
    tenant, data = r.meta.get(o.get("contextKey", column)), r.get("data")
    if tenant is not None and isinstance(data, dict) and column in data and data[column] != tenant:
        yield f"{column} may not be set to another tenant", ("data", column)


@rule
def require_tenant_on_create(r, o):
    if r.meta.get("tenantId") is None or r.kind not in ("create", "createMany", "upsert", "upsertMany"):
        return
    rows = r.get("create" if r.kind == "upsert" else "data")
    for row in rows if isinstance(rows, (list, tuple)) else [rows]:
        if isinstance(row, dict) and row.get("tenantId") is None:
            yield "the data needs tenantId", ("data", "tenantId")


@rule
def require_tenant_on_update(r, o):
    if r.kind in ("update", "updateMany", "updateEach", "upsert") and r.meta.get("tenantId") is not None and not r.has("where"):
        yield "updates need a where of the tenant", ("where",)


@rule
def require_tenant_on_delete(r, o):
    if r.kind in ("delete", "deleteMany") and r.meta.get("tenantId") is not None and not r.has("where"):
        yield "deletions need a where of the tenant", ("where",)


@rule
def no_sensitive_select(r, o):
    if not (o.get("allowWithSensitive") and r.args.get(o.get("withSensitiveArg", "withSensitive")) is True):
        for column in r.selects_sensitive():
            yield f"{column} is sensitive", ("select", column)


@rule
def require_explicit_sensitive_access_reason(r, o):
    allowed = r.args.get(o.get("withSensitiveArg", "withSensitive")) is True
    if r.selects_sensitive() and allowed and not r.reason(o.get("reasonArg", "reason")):
        yield "sensitive columns need a reason", ("reason",)


@rule
def no_query_deleted_without_explicit_opt_in(r, o):
    if r.args.get("deleted") in ("with", "only") and o.get("requireReason") and not r.reason(o.get("reasonArg", "reason")):
        yield "deleted rows need a reason", ("reason",)


@rule
def no_hard_delete_on_soft_delete_model(r, o):
    allowed = o.get("allowWithContextKey") and r.meta.get(o["allowWithContextKey"]) or o.get("allowWithReason") and r.reason()
    if r.kind == "delete" and r.args.get("mode") == "hard" and not allowed:
        yield "rows may not be deleted for good", ("mode",)


@rule
def require_hard_delete_reason(r, o):
    if r.kind == "delete" and r.args.get("mode") == "hard" and not r.reason(o.get("reasonArg", "reason")):
        yield "deleting for good needs a reason", ("reason",)


@rule
def no_system_mode_without_reason(r, o):
    if r.args.get("system") is True and not r.reason(o.get("reasonArg", "reason")):
        yield "system mode needs a reason", ("reason",)


@rule
def require_timeout_for_long_running_operation(r, o):
    timeout = r.args.get("timeoutMs")
    if not r.raw and r.kind != "explain" or not _kinds(r, o, "operations", ("raw", "executeRaw", "explain")):
        return
    if timeout is None:
        yield "this operation needs timeoutMs", ("timeoutMs",)
    elif o.get("maxTimeoutMs") is not None and timeout > o["maxTimeoutMs"]:
        yield f"timeoutMs {timeout} is above maxTimeoutMs {o['maxTimeoutMs']}", ("timeoutMs",)


#: Rules that may be configured but have no check: users' configurations stay valid (fixed values).
DECLARED_ONLY = (
    "noSensitiveFieldsInLogs",
    "requireRestoreReason",
    "noWithoutPlugins",
    "noPluginBypassWithoutReason",
    "requireAuditContext",
    "noAuditLogForIgnoredModelWrite",
    "maxNestedWriteDepth",
    "requireTransactionForNestedWrite",
    "requireUniqueWhereForConnect",
    "requireUniqueWhereForConnectOrCreate",
    "noAmbiguousNestedRelation",
    "requireWhereForAggregate",
    "requireLimitForGroupBy",
    "maxGroupByLimit",
    "requireOrderByForGroupByLimit",
    "noDynamicPreparedShape",
    "noPreparedNameConflict",
    "noUnsupportedDialectFeature",
    "noSilentDialectFallback",
)


def _setting(value: Any) -> tuple[str, dict]:
    """(level, options)"""
    if isinstance(value, dict):
        return value.get("level", "error"), value
    return {True: "error", "error": "error", "warn": "warn"}.get(value, "off") if value else "off", {}


def _in_scope(model: str | None, o: dict) -> bool:
    return model is None or (not o.get("models") or model in o["models"]) and model not in (o.get("ignoreModels") or ())


def evaluate(op: Operation, options: dict) -> list[Violation]:
    r, out = Request(op), []
    for name, check in RULES.items():
        level, o = _setting(options.get(name))
        if level != "off" and _in_scope(op.model, o):
            out += [Violation(name, level, message, path, op.kind, op.model, op.meta) for message, path in check(r, o)]
    return out


def rules(options: dict, *, on_violation: Callable[[Violation], None] | None = None, reporter: Any = None) -> Plugin:
    """``options``: settings by rule (True, "warn", "error", "off" or a dict with level, models, ignoreModels and
    the rule's own), and enabled, throwOnError, warnOnViolation."""
    unknown = [k for k in options if k not in RULES and k not in DECLARED_ONLY and k not in ("enabled", "throwOnError", "warnOnViolation")]
    if unknown:
        raise EngineError(ErrorCode.OPERATION_ERROR, "Unknown rules: " + ", ".join(unknown))

    def guard(op: Operation) -> None:
        if options.get("enabled") is False:
            return
        for v in evaluate(op, options):
            if on_violation:
                on_violation(v)
            text = f"{v.rule}: {v.message}"
            if v.level == "warn":
                if reporter is not None:
                    reporter.warn(text)
                elif options.get("warnOnViolation", True):
                    warnings.warn(text, stacklevel=2)
            else:
                if reporter is not None:
                    reporter.error(text)
                if options.get("throwOnError", True):
                    raise EngineError(ErrorCode.OPERATION_ERROR, text, details={"rule": v.rule, "path": v.path, "model": v.model, "operation": v.operation})

    hooks = {f"before{f}": guard for f in ("Create", "Update", "Delete", "Query", "Raw", "Transaction")}
    return Plugin("rules", hooks=hooks)


def merge_rules(*configs: dict | None) -> dict:
    """Later settings replace earlier ones, whole."""
    out: dict = {}
    for c in configs:
        out |= c or {}
    return out


# The presets' settings are fixed values.
_SAFE = {
    "enabled": True,
    "throwOnError": True,
    "warnOnViolation": True,
    "noDeleteManyWithoutWhere": "error",
    "noUpdateManyWithoutWhere": "error",
    "noDeleteWithoutWhere": "error",
    "noUpdateWithoutWhere": "error",
    "noEmptyWhere": {"level": "error", "operations": ["update", "updateMany", "delete", "deleteMany"], "treatUndefinedAsEmpty": True, "treatEmptyAndOrAsEmpty": True},
    "noUnboundedFindMany": {"level": "warn", "allowWithWhere": False, "allowWithLimit": True, "allowWithTake": True, "allowSmallStaticModels": True},
    "maxLimit": {"level": "warn", "value": 1000, "applyTo": ["findMany", "paginate", "cursor"]},
    "requireOrderByForCursor": "error",
    "requireTransactionForLock": "warn",
    "noLockWithInclude": "error",
    "noInvalidLockCombination": "error",
    "requireLimitForSkipLocked": "error",
    "noRawUnsafe": "error",
}
_RECOMMENDED = {
    "requireStableOrderByForCursor": {"level": "warn", "requirePrimaryKeyInOrderBy": False},
    "maxIncludeDepth": {"level": "warn", "value": 3},
    "maxIncludeRelations": {"level": "warn", "value": 5},
    "requireOrderByForSkipLocked": "warn",
    "requireRawTimeout": {"level": "warn", "defaultTimeoutMs": 5000, "maxTimeoutMs": 30000},
    "noRawMutation": {"level": "warn", "allow": ["create extension", "refresh materialized view"]},
    "requireTenantContext": {"level": "error", "allowSystem": True},
    "noSensitiveSelect": {"level": "error", "allowWithSensitive": True, "withSensitiveArg": "withSensitive"},
    "noHardDeleteOnSoftDeleteModel": {"level": "error", "allowWithReason": True},
    "noSystemModeWithoutReason": {"level": "warn", "reasonArg": "reason"},
    "requireTimeoutForLongRunningOperation": {"level": "warn", "operations": ["raw", "executeRaw", "explain"], "maxTimeoutMs": 60000},
}
_STRICT = {
    "noUnboundedFindMany": {"level": "error", "allowWithWhere": False, "allowWithLimit": True, "allowWithTake": True, "allowSmallStaticModels": False},
    "requireExplicitLimit": {"level": "warn", "operations": ["findMany"]},
    "maxLimit": {"level": "error", "value": 500, "applyTo": ["findMany", "paginate", "cursor"]},
    "requireOrderByForLimit": "warn",
    "requireOrderByForPagination": "warn",
    "requireStableOrderByForCursor": {"level": "error", "requirePrimaryKeyInOrderBy": False},
    "maxIncludeDepth": {"level": "error", "value": 2},
    "maxIncludeRelations": {"level": "error", "value": 3},
    "requireTransactionForLock": "error",
    "requireOrderByForSkipLocked": "error",
    "requireRawComment": {"level": "warn", "minLength": 8},
    "requireRawTimeout": {"level": "error", "defaultTimeoutMs": 5000, "maxTimeoutMs": 30000},
    "noRawMutation": {"level": "error", "allow": ["create extension", "refresh materialized view"]},
    "noRawWithoutTransaction": {"level": "warn", "onlyMutations": True},
    "noTenantBypassWithoutSystem": {"level": "error", "systemContextKey": "system"},
    "noTenantColumnOverride": {"level": "error", "contextKey": "tenantId", "tenantColumn": "tenantId"},
    "requireTenantOnCreate": "error",
    "requireTenantOnUpdate": "error",
    "requireTenantOnDelete": "error",
    "requireExplicitSensitiveAccessReason": {"level": "error", "reasonArg": "reason", "withSensitiveArg": "withSensitive"},
    "noQueryDeletedWithoutExplicitOptIn": {"level": "warn", "requireReason": True, "reasonArg": "reason"},
    "requireHardDeleteReason": {"level": "error", "reasonArg": "reason"},
    "noSystemModeWithoutReason": {"level": "error", "reasonArg": "reason"},
    "requireTimeoutForLongRunningOperation": {"level": "error", "operations": ["raw", "executeRaw", "explain"], "maxTimeoutMs": 30000},
}


def safe(overrides: dict | None = None) -> dict:
    return merge_rules(_SAFE, overrides)


def recommended(overrides: dict | None = None) -> dict:
    return merge_rules(_SAFE, _RECOMMENDED, overrides)


def strict(overrides: dict | None = None) -> dict:
    return merge_rules(_SAFE, _RECOMMENDED, _STRICT, overrides)

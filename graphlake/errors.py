"""One error type with codes, HTTP-like statuses, causes and classifiers of constraint violations."""

from __future__ import annotations

from enum import Enum
from typing import Any


class ErrorCode(str, Enum):
    # fixed values: the codes that users of the API match on
    AFTER_COMMIT_OUTSIDE_TRANSACTION = "AFTER_COMMIT_OUTSIDE_TRANSACTION"
    AFTER_ROLLBACK_OUTSIDE_TRANSACTION = "AFTER_ROLLBACK_OUTSIDE_TRANSACTION"
    DATABASE_ERROR = "DATABASE_ERROR"
    DIALECT_INFERENCE_FAILED = "DIALECT_INFERENCE_FAILED"
    JSONB_QUERY_UNSUPPORTED = "JSONB_QUERY_UNSUPPORTED"
    HOOK_ERROR = "HOOK_ERROR"
    LOCK_NOT_SUPPORTED = "LOCK_NOT_SUPPORTED"
    LOCK_REQUIRES_TRANSACTION = "LOCK_REQUIRES_TRANSACTION"
    LOCK_TIMEOUT = "LOCK_TIMEOUT"
    OPERATION_ERROR = "OPERATION_ERROR"
    PLUGIN_DIALECT_UNSUPPORTED = "PLUGIN_DIALECT_UNSUPPORTED"
    PLUGIN_DUPLICATE_ID = "PLUGIN_DUPLICATE_ID"
    PLUGIN_EXTENSION_CONFLICT = "PLUGIN_EXTENSION_CONFLICT"
    PLUGIN_OPERATION_ARG_CONFLICT = "PLUGIN_OPERATION_ARG_CONFLICT"
    PLUGIN_REQUIRED_COLUMN_MISSING = "PLUGIN_REQUIRED_COLUMN_MISSING"
    RAW_COMMENT_REQUIRED = "RAW_COMMENT_REQUIRED"
    RAW_ABORTED = "RAW_ABORTED"
    RAW_DISABLED = "RAW_DISABLED"
    RAW_INVALID_QUERY = "RAW_INVALID_QUERY"
    RAW_TIMEOUT = "RAW_TIMEOUT"
    RAW_UNSAFE_DISABLED = "RAW_UNSAFE_DISABLED"
    RAW_UNSAFE_PLACEHOLDER_MISMATCH = "RAW_UNSAFE_PLACEHOLDER_MISMATCH"
    RAW_UNSUPPORTED_OPTION = "RAW_UNSUPPORTED_OPTION"
    REPOSITORY_NOT_FOUND = "REPOSITORY_NOT_FOUND"
    RESULT_NOT_FOUND = "RESULT_NOT_FOUND"
    TABLE_RUNTIME_NOT_FOUND = "TABLE_RUNTIME_NOT_FOUND"
    TRANSACTION_ABORTED = "TRANSACTION_ABORTED"
    TRANSACTION_LIFECYCLE_STATE_MISSING = "TRANSACTION_LIFECYCLE_STATE_MISSING"
    TRANSACTION_RUNTIME_NOT_INITIALIZED = "TRANSACTION_RUNTIME_NOT_INITIALIZED"
    TRANSACTION_ROLLBACK = "TRANSACTION_ROLLBACK"
    TRANSACTIONS_UNSUPPORTED = "TRANSACTIONS_UNSUPPORTED"
    TRANSACTION_TIMEOUT = "TRANSACTION_TIMEOUT"
    TRANSACTION_UNSUPPORTED_OPTION = "TRANSACTION_UNSUPPORTED_OPTION"
    UNKNOWN = "UNKNOWN"


_STATUS = {
    404: (ErrorCode.RESULT_NOT_FOUND, ErrorCode.REPOSITORY_NOT_FOUND, ErrorCode.TABLE_RUNTIME_NOT_FOUND),
    408: (ErrorCode.RAW_TIMEOUT, ErrorCode.TRANSACTION_TIMEOUT, ErrorCode.LOCK_TIMEOUT),
    409: (ErrorCode.TRANSACTION_ROLLBACK,),
    400: (
        ErrorCode.OPERATION_ERROR,
        ErrorCode.RAW_INVALID_QUERY,
        ErrorCode.RAW_COMMENT_REQUIRED,
        ErrorCode.RAW_DISABLED,
        ErrorCode.RAW_UNSAFE_DISABLED,
        ErrorCode.RAW_UNSAFE_PLACEHOLDER_MISMATCH,
        ErrorCode.RAW_UNSUPPORTED_OPTION,
        ErrorCode.JSONB_QUERY_UNSUPPORTED,
        ErrorCode.LOCK_NOT_SUPPORTED,
        ErrorCode.LOCK_REQUIRES_TRANSACTION,
        ErrorCode.TRANSACTION_UNSUPPORTED_OPTION,
    ),
}
_STATUS_OF = {code: status for status, codes in _STATUS.items() for code in codes}


#: How databases say that a lock wasn't to be had: SQL state, error numbers and words (fixed values).
LOCK_STATE = "55P03"
LOCK_NUMBERS = (1205, 3572)
LOCK_WORDS = ("lock timeout", "could not obtain lock", "could not be acquired immediately", "nowait is set")


class EngineError(Exception):
    """``code``, ``status``, ``message``, ``details`` and the error that caused it."""

    def __init__(self, code: ErrorCode, message: str, *, status: int | None = None, details: dict | None = None, cause: BaseException | None = None):
        super().__init__(message)
        self.code, self.message = code, message
        self.status = status or _STATUS_OF.get(code, 500)
        self.details, self.cause = details or {}, cause
        self.__cause__ = cause

    @classmethod
    def of(cls, error: BaseException, code: ErrorCode = ErrorCode.UNKNOWN) -> EngineError:
        """The error itself if it is one of these, else one around it; Spark's errors are database errors."""
        if isinstance(error, cls):
            return error
        details = {}
        state = getattr(error, "sqlstate", None)
        if hasattr(error, "getCondition"):
            code, state = ErrorCode.DATABASE_ERROR, error.getSqlState()
            details = {"condition": error.getCondition(), "sqlState": state}
        if state == LOCK_STATE or getattr(error, "errno", None) in LOCK_NUMBERS or any(w in str(error).lower() for w in LOCK_WORDS):
            code = ErrorCode.LOCK_TIMEOUT
        return cls(code, str(error) or type(error).__name__, details=details, cause=error)

    def with_cause(self, cause: BaseException) -> EngineError:
        return EngineError(self.code, self.message, status=self.status, details=self.details, cause=cause)

    def with_details(self, **details: Any) -> EngineError:
        return EngineError(self.code, self.message, status=self.status, details=self.details | details, cause=self.cause)

    def to_json(self) -> dict:
        cause = {"name": type(self.cause).__name__, "message": str(self.cause)} if self.cause else None
        return {"name": type(self).__name__, "code": self.code.value, "status": self.status, "message": self.message, "details": self.details, "cause": cause}

    @property
    def violation(self) -> str | None:
        return self.details.get("violation")


def fail(message: str, **details: Any) -> EngineError:
    return EngineError(ErrorCode.OPERATION_ERROR, message, details=details)


def violation(kind: str, message: str, **details: Any) -> EngineError:
    """A broken constraint: unique, foreignKey, notNull or check."""
    return EngineError(ErrorCode.DATABASE_ERROR, message, status=409 if kind == "unique" else 400, details=details | {"violation": kind})


#: SQL states of broken constraints (fixed values of the SQL standard as databases extend it).
_STATES = {"unique": {"23505"}, "foreignKey": {"23503"}, "notNull": {"23502"}, "check": {"23514"}}
_WORDS = {
    "unique": ("unique constraint", "duplicate key", "duplicate entry"),
    "foreignKey": ("foreign key constraint",),
    "notNull": ("not null constraint", "null value in column", "not_null_assert_violation", "cannot be null"),
    "check": ("check constraint",),
}


def _is(kind: str, error: BaseException | None) -> bool:
    while error is not None:
        if isinstance(error, EngineError) and error.violation:
            return error.violation == kind
        state = error.getSqlState() if hasattr(error, "getSqlState") else getattr(error, "sqlstate", None)
        if state in _STATES[kind] or any(w in str(error).lower() for w in _WORDS[kind]):
            return True
        error = error.__cause__
    return False


def is_unique_violation(error: BaseException) -> bool:
    return _is("unique", error)


def is_foreign_key_violation(error: BaseException) -> bool:
    return _is("foreignKey", error)


def is_not_null_violation(error: BaseException) -> bool:
    return _is("notNull", error)


def is_check_violation(error: BaseException) -> bool:
    return _is("check", error)

"""explain(): the physical plan of every statement of a request."""

from __future__ import annotations

import time
from typing import Any

from pyspark.sql import DataFrame

from graphlake.errors import fail

# fixed values: the options that users of the API pass
_OPTIONS = {"analyze", "verbose", "costs", "timing", "summary", "timeoutMs", "name", "comment", "buffers", "settings", "wal", "format"}
_MODES = {"simple", "extended", "codegen", "cost", "formatted"}


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    jvm = df.sparkSession._jvm
    return df._jdf.queryExecution().explainString(jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))


def explain_statements(statements: dict[str, DataFrame], relations: list[dict], options: dict[str, Any]) -> dict:
    """{"statements": {key: {sql, params, plan, applied, ignored}}, "deferredRelations": [...]}. Relations are
    part of the data's plan here; the list names their paths. ``analyze`` runs the statement and times it."""
    unknown = set(options) - _OPTIONS
    if unknown:
        raise fail("Unknown explain options: " + ", ".join(sorted(unknown)))
    mode = options.get("format") or ("cost" if options.get("costs") else "extended" if options.get("verbose") else "formatted")
    if mode not in _MODES:
        raise fail(f'Unknown explain format "{mode}"')
    applied = {k: v for k, v in options.items() if v and k in ("analyze", "verbose", "costs", "timing", "name", "comment", "format")}
    out = {}
    for key, df in statements.items():
        entry = {"sql": None, "params": [], "plan": plan_text(df, mode), "applied": applied, "ignored": sorted(k for k, v in options.items() if v and k not in applied)}
        if options.get("analyze"):
            began = time.perf_counter()
            rows = df.count()
            entry |= {"rows": rows, "seconds": time.perf_counter() - began}
        out[key] = entry
    return {"dialect": "spark", "name": options.get("name"), "statements": out, "deferredRelations": relations}

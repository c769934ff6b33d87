"""Column expressions that are built once a session: each of their parts is a call into the JVM, and there are thousands."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from typing import Any

from pyspark import SparkContext


def once(build: Callable[..., Any]) -> Callable[..., Any]:
    """``build`` whose result is kept for its (hashable) arguments as long as the session's context is the same."""
    kept: dict[tuple, Any] = {}

    @wraps(build)
    def found(*args: Any) -> Any:
        context = SparkContext._active_spark_context
        if kept.get(()) is not context:
            kept.clear()
            kept[()] = context
        key = ("args", *args)
        if key not in kept:
            kept[key] = build(*args)
        return kept[key]

    return found

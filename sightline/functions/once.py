"""Expressions that are built once a session, and long constants as one expression."""

from __future__ import annotations

import functools

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(value: str) -> str:
    """A string as a SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def constant_words(values) -> Column:
    """An array of strings, as one expression: a literal for each word costs a round trip to the JVM each."""
    values = list(values)
    return F.expr(f"array({', '.join(map(quoted, values))})") if values else F.array().cast("array<string>")


def constant_map(pairs: dict) -> Column:
    """A map from strings to strings or whole numbers."""
    value = lambda v: quoted(v) if isinstance(v, str) else str(v)
    return F.expr(f"map({', '.join(f'{quoted(k)}, {value(v)}' for k, v in pairs.items())})")


def once(build):
    """For functions of plain values that give Columns over fixed names: each call with equal values gives what the first one built. Columns are descriptions, so any plan may share them."""
    kept: dict = {}

    @functools.wraps(build)
    def get(*args):
        context = SparkContext._active_spark_context
        if kept.get("context") is not context:
            kept.clear()
            kept["context"] = context
        key = repr(args)
        if key not in kept:
            kept[key] = build(*args)
        return kept[key]

    return get

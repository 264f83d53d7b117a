"""A two-valued filter algebra that fails closed.

Each leaf on a null field is false except ``is_null``; negation negates a
two-valued value.  So ``not_in`` on null is false while ``not(eq)`` on null is
true, unlike SQL's three-valued logic.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Leaf:
    field: str
    op: str
    value: Any = None


@dataclass(frozen=True)
class Group:
    op: str
    parts: tuple


_COMPARE = {
    "eq": lambda c, v: c == v,
    "ne": lambda c, v: c != v,
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
    "in": lambda c, v: c.isin(*v),
    "not_in": lambda c, v: ~c.isin(*v),
}


def predicate(node: Leaf | Group) -> Column:
    """The filter as a column that is true or false, never null."""
    if isinstance(node, Group):
        parts = [predicate(p) for p in node.parts]
        if node.op == "not":
            (only,) = parts
            return ~only
        if node.op not in ("and", "or"):
            raise ValueError(f"unknown group {node.op!r}")
        out = F.lit(node.op == "and")
        for p in parts:
            out = out & p if node.op == "and" else out | p
        return out
    column = F.col(node.field)
    if node.op == "is_null":
        return column.isNull()
    if node.op == "is_not_null":
        return column.isNotNull()
    if node.op not in _COMPARE:
        raise ValueError(f"unknown operator {node.op!r}")
    return F.coalesce(_COMPARE[node.op](column, node.value), F.lit(False))


def tenant(df: DataFrame, namespace: str, column: str = "namespace") -> DataFrame:
    """Rows of one namespace, by exact equality; an empty namespace is refused."""
    if not namespace:
        raise ValueError("a namespace is required")
    return df.where(F.col(column) == F.lit(namespace))


def entitled(field: str, granted: list[str], as_of: datetime, now: datetime, most: timedelta) -> Column:
    """Whether a row's field is granted; a stale snapshot grants nothing, nor does a null field."""
    if now - as_of > most or not granted:
        return F.lit(False)
    return F.coalesce(F.col(field).isin(*granted), F.lit(False))

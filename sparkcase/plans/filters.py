"""Filter expressions as small value objects, compiled to Spark predicates that Catalyst pushes to the scan."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Eq:
    column: str
    value: Any


@dataclass(frozen=True)
class In:
    column: str
    values: tuple


@dataclass(frozen=True)
class Like:
    column: str
    pattern: str
    escape: str | None = None


@dataclass(frozen=True)
class And:
    filters: tuple = ()

    def __init__(self, *filters):
        object.__setattr__(self, "filters", filters)


@dataclass(frozen=True)
class Or:
    filters: tuple = ()

    def __init__(self, *filters):
        object.__setattr__(self, "filters", filters)


@dataclass(frozen=True)
class Not:
    filter: Any


@dataclass(frozen=True)
class Raw:
    sql: str


def compile_filter(f) -> Column:
    """The predicate of a filter; without an escape character a backslash in a pattern stands for itself."""
    match f:
        case Eq(column, value):
            return F.col(column) == F.lit(value)
        case In(column, values):
            return F.col(column).isin(*values) if values else F.lit(False)
        case Like(column, pattern, None):
            return F.like(F.col(column), F.lit(pattern.replace("\\", "\\\\")))
        case Like(column, pattern, escape):
            return F.like(F.col(column), F.lit(pattern), F.lit(escape))
        case And(filters):
            out = F.lit(True)
            for x in filters:
                out = out & compile_filter(x)
            return out
        case Or(filters):
            out = F.lit(False)
            for x in filters:
                out = out | compile_filter(x)
            return out
        case Not(inner):
            return ~compile_filter(inner)
        case Raw(sql):
            return F.expr(sql)
    raise TypeError(f"unknown filter {f!r}")

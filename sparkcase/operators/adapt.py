"""Adaptation: expressions that change a case in the light of the query; inputs are never altered in place."""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.measures import Measure, lazy_udf, scalar
from ..functions.pooling import aggregator

Adaptation = Callable[[Column, Column], Column]


def attribute_value(attributes: Mapping[str, Adaptation | Sequence[Adaptation]]) -> Adaptation:
    """Adapts single attributes, each by one function or by several in turn."""

    def f(case, query):
        out = case
        for name, chain in attributes.items():
            value = case[name]
            for g in [chain] if callable(chain) else chain:
                value = g(value, query[name])
            out = out.withField(name, value)
        return out

    return f


def pipe(functions: Sequence[Adaptation], similarity: Measure | None = None, delta: float = 0.0, strategy: str = "continue", compare_to: str = "case") -> Adaptation:
    """Functions in turn. With a similarity a change is accepted only if its score is at least the current one plus ``delta``.

    The first score is that of case and query; later ones compare the current value with the changed one, or, with
    ``compare_to="query"``, the changed one with the query. ``strategy="break"`` stops at the first refusal.
    """

    def f(case, query):
        current = case
        if similarity is None:
            for g in functions:
                current = g(current, query)
            return current
        best, open_ = scalar(similarity)(case, query), F.lit(True)
        for g in functions:
            changed = g(current, query)
            now = scalar(similarity)(current, changed) if compare_to == "case" else scalar(similarity)(changed, query)
            accepted = open_ & (now >= best + delta)
            if strategy == "break":
                open_ = accepted
            best = F.when(accepted, now).otherwise(best)
            current = F.when(accepted, changed).otherwise(current)
        return current

    return f


def null(target: str = "case") -> Adaptation:
    return lambda case, query: case if target == "case" else query


def regex(case_pattern: str, query_pattern: str, replacement: str | Callable[[re.Match, re.Match], str], count: int = 0, pos: int = 0, endpos: int | None = None) -> Adaptation:
    """Where the query has its pattern between ``pos`` and ``endpos``, replaces the case's, the first ``count`` or all.

    A plain replacement of all places stays in generated code. A replacement made from the match of the case and that
    of the query, and one of some places, runs as an Arrow-batched function.
    """

    def plain(case, query):
        part = query if pos == 0 and endpos is None else F.substr(query, F.lit(pos + 1), F.lit(max(0, (endpos if endpos is not None else 1 << 30) - pos)))
        return F.when(F.regexp(part, F.lit(query_pattern)), F.regexp_replace(case, case_pattern, literal)).otherwise(case)

    if count == 0 and isinstance(replacement, str):
        literal = re.sub(r"([\\$])", r"\\\1", replacement)
        return plain
    of_case, of_query = re.compile(case_pattern), re.compile(query_pattern)
    end = sys.maxsize if endpos is None else endpos

    def one(case: str | None, query: str | None) -> str | None:
        hit = None if case is None or query is None else of_query.search(query, pos, end)
        return case if hit is None else of_case.sub((lambda m: replacement) if isinstance(replacement, str) else (lambda m: replacement(m, hit)), case, count=count)

    run = lazy_udf(lambda case, query: pd.Series([one(a, b) for a, b in zip(case, query)], dtype=object), "string")
    return lambda case, query: run(case, query)


def aggregate(pooling="mean", case_factor: float = 1.0, query_factor: float = 1.0) -> Adaptation:
    """Pools the scaled case and query."""
    pool = aggregator(pooling)
    return lambda case, query: pool([case.cast("double") * case_factor, query.cast("double") * query_factor])

"""Pooling of one row's scores: array columns in, a double out; nothing is shuffled.

Functions over arrays are interpreted for each row, so means and sums of known columns are made without an array.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Pooling = Callable[[Column], Column]


def _sum(a: Column, of=lambda v: v) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + of(v))


def mean(a: Column) -> Column:
    return _sum(a) / F.size(a)


def geometric_mean(a: Column) -> Column:
    logs = F.exp(_sum(a, lambda v: F.log(v)) / F.size(a))
    negative = F.raise_error(F.lit("geometric mean of a negative score")).cast("double")
    return F.when(F.exists(a, lambda v: v < 0), negative).when(F.exists(a, lambda v: v == 0), 0.0).otherwise(logs)


def harmonic_mean(a: Column) -> Column:
    negative = F.raise_error(F.lit("harmonic mean of a negative score")).cast("double")
    return F.when(F.exists(a, lambda v: v < 0), negative).when(F.exists(a, lambda v: v == 0), 0.0).otherwise(F.size(a) / _sum(a, lambda v: 1.0 / v))


def _nth(a: Column, position: Column) -> Column:
    return F.try_element_at(F.array_sort(a), position.cast("int"))


def median(a: Column) -> Column:
    return (median_low(a) + median_high(a)) / 2


def median_low(a: Column) -> Column:
    return _nth(a, F.floor((F.size(a) + 1) / 2))


def median_high(a: Column) -> Column:
    return _nth(a, F.floor(F.size(a) / 2) + 1)


def mode(a: Column) -> Column:
    """The most frequent score; of several the one seen first."""
    counted = F.transform(F.array_distinct(a), lambda v: F.struct(F.size(F.filter(a, lambda u: u == v)).alias("n"), (-F.array_position(a, v)).alias("at"), v.alias("v")))
    return F.array_max(counted)["v"]


def k_min(k: int) -> Pooling:
    return lambda a: _nth(a, F.least(F.lit(max(k, 1)), F.size(a)))


def k_max(k: int) -> Pooling:
    return lambda a: _nth(a, F.size(a) + 1 - F.least(F.lit(max(k, 1)), F.size(a)))


def minkowski(p: float) -> Pooling:
    if p == float("inf"):
        return F.array_max
    if p == float("-inf"):
        return F.array_min
    return lambda a: F.pow(_sum(a, lambda v: F.pow(F.abs(v), F.lit(float(p)))), F.lit(1.0 / p))


def euclidean(a: Column) -> Column:
    return F.sqrt(_sum(a, lambda v: v * v))


POOLINGS: dict[str, Pooling] = {
    "mean": mean, "fmean": mean, "geometric_mean": geometric_mean, "harmonic_mean": harmonic_mean, "median": median,
    "median_low": median_low, "median_high": median_high, "mode": mode, "min": F.array_min, "max": F.array_max, "sum": _sum,
    "euclidean": euclidean,
}


#: Of at most so many columns a mean or sum is one expression; of more it would be too deep.
ADDED = 64


def _pooled(pool: Pooling, columns: Sequence[Column]) -> Column:
    """``pool`` of the columns' values; the mean and the sum of given columns stay in generated code, added in the same order."""
    if pool not in (mean, _sum) or not 0 < len(columns) <= ADDED:
        return pool(F.array(*columns))
    total = F.lit(0.0)
    for c in columns:
        total = total + c
    return total / F.lit(len(columns)) if pool is mean else total


def aggregator(pooling: str | Pooling = "mean", weights: Mapping | Sequence | None = None, default_weight: float = 1.0):
    """Turns named or positional score columns (or an array column) into one score.

    With weights each score is scaled by its own, and the pooled value by ``n / sum(weights)``, whatever the pooling.
    Named weights need named scores, positional ones as many positional scores.
    """
    pool = POOLINGS[pooling] if isinstance(pooling, str) else pooling

    def apply(scores) -> Column:
        if isinstance(scores, Column):
            if weights is None:
                return pool(scores)
            w = F.array(*(F.lit(float(v)) for v in weights))
            return pool(F.zip_with(scores, w, lambda s, v: s * v)) * (F.size(scores) / float(sum(weights)))
        named = isinstance(scores, Mapping)
        if weights is not None and named != isinstance(weights, Mapping):
            raise TypeError("weights and scores must both be named or both be positional")
        columns = list(scores.values()) if named else list(scores)
        if weights is None:
            return _pooled(pool, columns)
        w = [float(weights.get(k, default_weight)) for k in scores] if named else [float(v) for v in weights]
        if len(w) != len(columns):
            raise ValueError("as many weights as scores are needed")
        if sum(w) == 0:
            raise ZeroDivisionError("the weights sum to zero")
        return _pooled(pool, [c * v for c, v in zip(columns, w)]) * (len(columns) / sum(w))

    return apply

"""Similarity measures as compilers: ``measure(case, query)`` gives the expression of the score.

A measure returns a double, or a struct with a field ``value``; ``value_of`` reads either. Measures made of built-in
functions stay inside generated code; those that search for an alignment run as Arrow-batched functions.
"""

from __future__ import annotations

import csv
import fnmatch
import json
import math
import re
from collections import Counter
from collections.abc import Callable, Mapping, Sequence
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import kernels
from .pooling import aggregator

Measure = Callable[[Column, Column], Column]


def structured(measure: Measure) -> Measure:
    """Marks a measure whose result is a struct with a field ``value``."""
    measure.structured = True
    return measure


def lazy_udf(function: Callable, kind: str) -> Callable:
    """An Arrow-batched function made when it is first used, so measures may be built before there is a session."""
    return lambda *columns: F.pandas_udf(function, kind)(*columns)


def value_of(measure: Measure, score: Column) -> Column:
    return score["value"] if getattr(measure, "structured", False) else score


def scalar(measure: Measure) -> Measure:
    return lambda x, y: value_of(measure, measure(x, y))


def _double(c: Column) -> Column:
    return c.cast("double")


def distance(x: Column, y: Column) -> Column:
    return F.abs(_double(x) - _double(y))


def dist2sim(d: Column) -> Column:
    return 1.0 / (1.0 + d)


# Numbers


def linear_interval(low: float, high: float) -> Measure:
    def f(x, y):
        inside = _double(x).between(low, high) & _double(y).between(low, high)
        return F.when(inside, 1.0 - distance(x, y) / float(high - low)).otherwise(F.when(x.isNotNull() & y.isNotNull(), 0.0))

    return f


def linear(high: float, low: float = 0.0) -> Measure:
    def f(x, y):
        d = distance(x, y)
        slope = (float(high) - d) / float(high - low) if high != low else F.lit(1.0)
        return F.when(d < low, 1.0).when(d > high, 0.0).when(d.isNotNull(), slope)

    f.pruning = (float(high), float(low))
    return f


def threshold(limit: float) -> Measure:
    def f(x, y):
        d = distance(x, y)
        return F.when(d <= limit, 1.0).when(d.isNotNull(), 0.0)

    return f


def exponential(alpha: float = 1.0) -> Measure:
    return lambda x, y: F.exp(-float(alpha) * distance(x, y))


def sigmoid(alpha: float = 1.0, theta: float = 1.0) -> Measure:
    return lambda x, y: 1.0 / (1.0 + F.exp((distance(x, y) - float(theta)) / float(alpha)))


# Any type


def equality() -> Measure:
    return lambda x, y: _double(x == y)


def static(value: float) -> Measure:
    return lambda x, y: F.lit(float(value))


def type_equality(x_type, y_type) -> Measure:
    """Types are known before a query runs: 1 where the two data types are the same."""
    return lambda x, y: F.lit(float(x_type == y_type))


def _error(text: str) -> Column:
    return F.raise_error(F.lit(text)).cast("double")


def _text(key) -> str:
    """A table key as Spark casts it to a string; keys are strings, integers or booleans."""
    return str(key).lower() if isinstance(key, bool) else str(key)


def static_table(entries, symmetric: bool = True, default=None) -> Measure:
    """Looks ``(case, query)`` up in ``entries``, a map of pairs or triples; without a default a missing pair is an error."""
    rows = [(k[0], k[1], v) for k, v in entries.items()] if isinstance(entries, Mapping) else list(entries)
    known: dict = {}
    for a, b, v in rows:
        known[a, b] = float(v)
        if symmetric:
            known[b, a] = float(v)

    def f(x, y):
        other = default(x, y) if callable(default) else _error("pair is not in the table") if default is None else F.lit(float(default))
        if not known:
            return F.when(x.isNotNull() & y.isNotNull(), other)
        rows: dict = {}
        for (a, b), v in known.items():
            rows.setdefault(_text(a), {})[_text(b)] = v
        # One literal, folded when the query is planned: a map of maps, so a look-up passes over two short lists.
        table = F.from_json(F.lit(json.dumps(rows)), "map<string,map<string,double>>")
        found = F.try_element_at(F.try_element_at(table, x.cast("string")), y.cast("string"))
        return F.when(x.isNotNull() & y.isNotNull(), F.coalesce(found, other))

    return f


table = static_table


def dynamic_table(entries: Mapping, symmetric: bool = True, default: Measure | float | None = None, key: Callable[[Column], Column] = lambda c: c) -> Measure:
    """Picks the measure by the pair of keys; a single key ``k`` means ``(k, k)``."""
    known: dict = {}
    for k, m in entries.items():
        a, b = k if isinstance(k, tuple) else (k, k)
        known[a, b] = m
        if symmetric:
            known[b, a] = m

    def f(x, y):
        out = None
        for (a, b), m in known.items():
            hit = (key(x) == F.lit(a)) & (key(y) == F.lit(b))
            out = F.when(hit, scalar(m)(x, y)) if out is None else out.when(hit, scalar(m)(x, y))
        other = scalar(default)(x, y) if callable(default) else _error("no measure for the pair of keys") if default is None else F.lit(float(default))
        return other if out is None else out.otherwise(other)

    return f


def attribute_table(entries: Mapping, attribute: str, default=None) -> Measure:
    """Picks the measure by an attribute's value in both, without the mirrored pairs."""
    return dynamic_table(entries, symmetric=False, default=default, key=lambda c: c[attribute])


def type_table(entries: Mapping, kind: str = "kind", default=None) -> Measure:
    """Picks the measure by the field ``kind`` of a tagged union."""
    return attribute_table(entries, kind, default)


def transpose(measure: Measure, to_x: Callable[[Column], Column], to_y: Callable[[Column], Column] | None = None) -> Measure:
    f = lambda x, y: measure(to_x(x), (to_y or to_x)(y))
    return structured(f) if getattr(measure, "structured", False) else f


def transpose_value(measure: Measure, field: str = "value") -> Measure:
    return transpose(measure, lambda c: c[field])


def reverse(measure: Measure) -> Measure:
    f = lambda x, y: measure(y, x)
    return structured(f) if getattr(measure, "structured", False) else f


def combine(measures: Mapping[str, Measure] | Sequence[Measure], aggregate=None) -> Measure:
    """Several measures of one pair, aggregated."""
    aggregate = aggregate or aggregator()

    def f(x, y):
        if isinstance(measures, Mapping):
            return aggregate({k: scalar(m)(x, y) for k, m in measures.items()})
        return aggregate([scalar(m)(x, y) for m in measures])

    return f


def attribute_value(attributes: Mapping[str, Measure], aggregate=None, default: float | None = None, value: Callable[[Column, str], Column] = lambda c, a: c[a]) -> Measure:
    """Struct of the value aggregated over the attributes and each attribute's own score.

    A null on either side gives ``default``; without one it is an error.
    """
    aggregate = aggregate or aggregator()

    @structured
    def f(x, y):
        scores = {}
        for name, measure in attributes.items():
            a, b = value(x, name), value(y, name)
            other = F.lit(float(default)) if default is not None else _error(f"attribute {name} is null")
            score = measure(a, b)
            if getattr(measure, "structured", False):
                scores[name] = score
            else:
                scores[name] = F.when(a.isNull() | b.isNull(), other).otherwise(score if default is None else F.coalesce(score, other))
        plain = {k: value_of(attributes[k], v) for k, v in scores.items()}
        return F.struct(aggregate(plain).alias("value"), F.struct(*(v.alias(k) for k, v in scores.items())).alias("attributes"))

    return f


# Strings


def string_table(entries, symmetric: bool = True, default=0.0, case_sensitive: bool = True) -> Measure:
    """A table of pairs of strings; ``entries`` may be the path of a CSV file ``a,b,score`` without a header."""
    if isinstance(entries, str | Path):
        if Path(entries).suffix != ".csv":
            raise ValueError("entries are read from a .csv file only")
        with open(entries, newline="") as f:
            entries = [(a, b, float(v)) for a, b, v in csv.reader(f)]
    if case_sensitive:
        return static_table(entries, symmetric, default)
    rows = [(k[0], k[1], v) for k, v in entries.items()] if isinstance(entries, Mapping) else entries
    return transpose(static_table([(a.lower(), b.lower(), v) for a, b, v in rows], symmetric, default), F.lower)


def regex(case_sensitive: bool = True) -> Measure:
    """The query is the pattern; it must match the case from its start on."""
    flags = "" if case_sensitive else "(?i)"
    return lambda x, y: _double(F.regexp(x, F.concat(F.lit(flags + "^(?:"), y, F.lit(")"))))


def glob(case_sensitive: bool = True) -> Measure:
    """The query is a pattern of ``*``, ``?``, ``[..]`` and ``[!..]`` that must match the whole case."""

    def translate(patterns: pd.Series) -> pd.Series:
        seen = {p: re.sub(r"\(\?s:(.*)\)\\[zZ]", r"^(?s:\1)$", fnmatch.translate(p)) for p in patterns.dropna().unique()}
        return patterns.map(seen)

    to_regex = lazy_udf(translate, "string")

    if case_sensitive:
        return lambda x, y: _double(F.regexp(x, to_regex(y)))
    return lambda x, y: _double(F.regexp(F.lower(x), to_regex(F.lower(y))))


def ngram(n: int, case_sensitive: bool = False, tokenizer: Callable[[Column], Column] | None = None) -> Measure:
    """Jaccard similarity of the sets of n-grams; null where neither side has any."""

    def grams(c):
        t = c if case_sensitive else F.lower(c)
        if tokenizer is not None:
            units = tokenizer(t)
            last = F.size(units) - n + 1
            return F.when(last < 1, F.array().cast("array<array<string>>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.slice(units, i, n))))
        last = F.length(t) - n + 1
        return F.when(last < 1, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substr(t, i, F.lit(n)))))

    def f(x, y):
        a, b = grams(x), grams(y)
        return F.try_divide(_double(F.size(F.array_intersect(a, b))), _double(F.size(F.array_union(a, b))))

    return f


def _kernel(of, kind: str = "double") -> Measure:
    """An Arrow-batched measure; equal pairs within a batch are computed once."""

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        memo: dict = {}
        out = []
        for a, b in zip(x, y):
            if a is None or b is None:
                out.append(None)
                continue
            key = (a, b) if isinstance(a, str) else None
            if key is None:
                out.append(of(a, b))
            else:
                if key not in memo:
                    memo[key] = of(a, b)
                out.append(memo[key])
        return pd.Series(out, dtype=object if kind != "double" else float)

    return lazy_udf(run, kind)


def levenshtein(score_cutoff: float = 0.0, case_sensitive: bool = True) -> Measure:
    """Normalised indel ratio ``2 LCS / (len x + len y)``; below the cutoff 0."""
    m = _kernel(lambda a, b: (lambda v: v if v >= score_cutoff else 0.0)(kernels.indel_ratio(a, b)))
    return m if case_sensitive else transpose(m, F.lower)


def jaro(score_cutoff: float = 0.0, case_sensitive: bool = True) -> Measure:
    m = _kernel(lambda a, b: (lambda v: v if v >= score_cutoff else 0.0)(kernels.jaro(a, b)))
    return m if case_sensitive else transpose(m, F.lower)


def jaro_winkler(score_cutoff: float = 0.0, prefix_weight: float = 0.1, case_sensitive: bool = True) -> Measure:
    m = _kernel(lambda a, b: (lambda v: v if v >= score_cutoff else 0.0)(kernels.jaro_winkler(a, b, prefix_weight)))
    return m if case_sensitive else transpose(m, F.lower)


# Collections and sequences


def jaccard() -> Measure:
    """``1 / (1 + Jaccard distance)`` of two arrays as sets; null where both are empty."""

    def f(x, y):
        common, whole = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
        return dist2sim(F.try_divide(_double(whole - common), _double(whole)))

    return f


def isolated_mapping(element: Measure) -> Measure:
    """Mean over the query's items of the best score with any item of the case."""

    def f(x, y):
        best = F.transform(y, lambda q: F.coalesce(F.array_max(F.transform(x, lambda c: scalar(element)(q, c))), F.lit(0.0)))
        return F.when(F.size(y) == 0, 0.0).otherwise(F.aggregate(best, F.lit(0.0), lambda s, v: s + v) / F.size(y))

    return f


def equal(a, b) -> float:
    return float(a == b)


def difference(a, b):
    return abs(a - b)


def mapping(item_similarity: Callable = equal) -> Measure:
    """Best one-to-one assignment of items ``(case, query)`` by a Python function, divided by the query's size.

    By equality of strings it pairs each item as often as both sides have it, so these are counted.
    """

    def value(a, b):
        if not len(a) or not len(b):
            return 0.0
        if item_similarity is equal and _strings(a) and _strings(b):
            return float((Counter(a) & Counter(b)).total()) / len(b)
        return kernels.assignment_value([[float(item_similarity(p, q)) for q in b] for p in a]) / len(b)

    return _kernel(value)


def sequence_correctness(worst_case_sim: float = 0.0) -> Measure:
    """Concordant less discordant pairs of the case's items by their first places in the query."""
    count = lazy_udf(lambda at: pd.Series([None if a is None else kernels.rising(np.asarray(a, float)) for a in at], dtype=float), "double")

    def f(x, y):
        n = F.size(x)
        # Places of sequences of unequal length are not needed.
        rising = count(F.when(n == F.size(y), F.transform(x, lambda v: F.array_position(y, v))))
        pairs = n * (n - 1) / 2
        v = (2 * rising - pairs) / pairs
        return F.when(n != F.size(y), 0.0).when(n < 2, 0.0).when(v >= 0, v).otherwise(F.abs(v) * float(worst_case_sim))

    return f


def sequence_mapping(element: Measure, exact: bool = False, weights: Sequence[tuple] | None = None) -> Measure:
    """Struct of the mean of local scores and the local scores.

    ``exact`` asks for equal lengths; otherwise the shorter sequence slides over the longer one and the first best
    window above 0 counts. ``weights`` are ``(weight, low, high[, low_open, high_open])`` intervals of local scores.
    """

    def pooled(local):
        plain = F.when(F.size(local) == 0, 1.0).otherwise(F.aggregate(local, F.lit(0.0), lambda s, v: s + v) / F.size(local))
        if not weights:
            return plain
        top, total = F.lit(0.0), F.lit(0.0)
        for weight, low, high, *opened in weights:
            lo, hi = (*opened, False, False)[:2]
            w = float(weight) / (high - low)
            inside = F.filter(local, lambda v, a=low, b=high, p=lo, q=hi: ((v > a) if p else (v >= a)) & ((v < b) if q else (v <= b)))
            top = top + F.aggregate(inside, F.lit(0.0), lambda s, v: s + v) * w
            total = total + F.size(inside) * w
        return F.when(total > 0, top / total).otherwise(plain)

    @structured
    def f(x, y):
        none = F.array().cast("array<double>")
        if exact:
            local = F.when(F.size(x) == F.size(y), F.zip_with(x, y, lambda a, b: scalar(element)(a, b))).otherwise(none)
            return F.struct(F.when(F.size(x) != F.size(y), 0.0).otherwise(pooled(local)).alias("value"), local.alias("similarities"))
        n, m = F.size(x), F.size(y)
        short = F.least(n, m)
        shifts = F.sequence(F.lit(0), F.abs(n - m))

        def window(k):
            a = F.when(n > m, F.slice(x, k + 1, short)).otherwise(x)
            b = F.when(n > m, y).otherwise(F.slice(y, k + 1, short))
            local = F.zip_with(a, b, lambda p, q: scalar(element)(p, q))
            return F.struct(pooled(local).alias("value"), (-k).alias("k"), local.alias("similarities"))

        best = F.array_max(F.transform(shifts, window))
        empty = F.struct(F.lit(0.0).alias("value"), none.alias("similarities"))
        found = F.struct(best["value"].alias("value"), best["similarities"].alias("similarities"))
        return F.when((short == 0) & (n == m), F.struct(F.lit(1.0).alias("value"), none.alias("similarities"))).when((short == 0) | (best["value"] <= 0), empty).otherwise(found)

    return f


_ALIGNED = "struct<value double, pairs array<struct<query int, case int>>>"


def _strings(items) -> bool:
    return all(isinstance(v, str) for v in items)


def _numbers(items) -> bool:
    return isinstance(items, np.ndarray) and items.dtype == np.float64 and bool(np.isfinite(items).all())


def _aligned(run, pairs: bool = True, many: Callable | None = None, fits: Callable = _numbers) -> Measure:
    """``many`` gives the values of lists of items that all ``fits`` at once; it is used where ``pairs`` are not asked for."""

    def kernel(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        rows = [(None, None) if a is None or b is None else run(list(a), list(b)) for a, b in zip(x, y)]
        return pd.DataFrame({"value": [r[0] for r in rows], "pairs": [None if r[1] is None else [{"query": q, "case": c} for q, c in r[1]] for r in rows]})

    def values(x: pd.Series, y: pd.Series) -> pd.Series:
        out, fast = [None] * len(x), []
        for k, (a, b) in enumerate(zip(x, y)):
            if a is not None and b is not None:
                if many and fits(a) and fits(b):
                    fast.append(k)
                else:
                    out[k] = run(list(a), list(b))[0]
        for k, v in zip(fast, many([x.iloc[k] for k in fast], [y.iloc[k] for k in fast]) if fast else ()):
            out[k] = float(v)
        return pd.Series(out, dtype=float)

    return structured(lazy_udf(kernel, _ALIGNED)) if pairs else lazy_udf(values, "double")


def dtw(item_distance: Callable = difference, pairs: bool = True) -> Measure:
    """Struct of ``1 / (1 + D)`` for the dynamic time warping distance ``D`` and the aligned positions; without ``pairs`` the score alone."""
    return _aligned(lambda a, b: kernels.dtw(a, b, item_distance), pairs, kernels.dtw_values if item_distance is difference else None)


def twed(item_distance: Callable = difference, timestamp: Callable | None = None, stiffness: float = 0.001, penalty: float = 1.0, origin=0.0, pairs: bool = True) -> Measure:
    """Struct of ``1 / (1 + D)`` for the time warp edit distance ``D``; a virtual sample stands before each series."""
    if stiffness < 0 or penalty < 0:
        raise ValueError("stiffness and penalty must not be negative")
    many = (lambda xs, ys: kernels.twed_values(xs, ys, stiffness, penalty, origin)) if item_distance is difference and timestamp is None else None
    return _aligned(lambda a, b: kernels.twed(a, b, item_distance, timestamp, stiffness, penalty, origin), pairs, many)


def smith_waterman(item_similarity: Callable = equal, deletion: float = -1.0, insertion: float = -1.0, pairs: bool = True) -> Measure:
    """Local alignment that ends at the query's last item, as a share of the query's length."""
    many = (lambda xs, ys: kernels.smith_waterman_values(xs, ys, deletion, insertion)) if item_similarity is equal else None
    return _aligned(lambda a, b: kernels.smith_waterman(a, b, item_similarity, deletion, insertion), pairs, many, _strings)


# Vectors


def _dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: _double(a) * _double(b)), F.lit(0.0), lambda s, v: s + v)


def _norm(x: Column) -> Column:
    return F.sqrt(_dot(x, x))


def _unit(v: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v + 1.0) / 2.0))


def _cos(x: Column, y: Column) -> Column:
    return F.try_divide(_dot(x, y), _norm(x) * _norm(y))


def _nonzero(x, y, score) -> Column:
    return F.when((_norm(x) == 0) | (_norm(y) == 0), 0.0).otherwise(score)


def cosine() -> Measure:
    return lambda x, y: _nonzero(x, y, _unit(_cos(x, y)))


def dot() -> Measure:
    return lambda x, y: _nonzero(x, y, _unit(_dot(x, y)))


def angular() -> Measure:
    return lambda x, y: _nonzero(x, y, 1.0 - F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _cos(x, y)))) / math.pi)


def euclidean() -> Measure:
    return lambda x, y: dist2sim(F.sqrt(F.aggregate(F.zip_with(x, y, lambda a, b: F.pow(_double(a) - _double(b), F.lit(2))), F.lit(0.0), lambda s, v: s + v)))


def manhattan() -> Measure:
    return lambda x, y: dist2sim(F.aggregate(F.zip_with(x, y, lambda a, b: F.abs(_double(a) - _double(b))), F.lit(0.0), lambda s, v: s + v))


def _sparse(x: Column, y: Column) -> Column:
    both = F.array_intersect(F.map_keys(x), F.map_keys(y))
    return F.aggregate(both, F.lit(0.0), lambda s, k: s + _double(F.try_element_at(x, k)) * _double(F.try_element_at(y, k)))


def sparse_dot() -> Measure:
    return lambda x, y: F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(_unit(_sparse(x, y)))


def sparse_cosine() -> Measure:
    def f(x, y):
        norms = F.sqrt(_sparse(x, x)) * F.sqrt(_sparse(y, y))
        return F.when(norms == 0, 0.0).otherwise(_unit(F.try_divide(_sparse(x, y), norms)))

    return f


def embed(embedder: Callable[[Column], Column], metric: Measure, query_embedder: Callable[[Column], Column] | None = None) -> Measure:
    """The metric of two embedded texts; embed distinct texts into a column first where texts repeat."""
    return transpose(metric, embedder, query_embedder)


def concat_embeddings(*embedders: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda c: F.concat(*(e(c) for e in embedders))


def hashing_embedder(size: int = 64) -> Callable[[Column], Column]:
    """An embedder without a model: counts of the words' hashes in ``size`` places."""

    def f(c):
        places = F.transform(F.filter(F.split(F.lower(c), r"\W+"), lambda w: w != ""), lambda w: F.pmod(F.xxhash64(w), F.lit(size)))
        return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: _double(F.size(F.filter(places, lambda p: p == i))))

    return f


def keyword_embedder(words: Sequence[str]) -> Callable[[Column], Column]:
    """1 for each keyword that the text contains; all ones where it contains none."""

    def f(c):
        hits = F.array(*(_double(F.contains(F.lower(c), F.lit(w))) for w in words))
        return F.when(F.exists(hits, lambda v: v > 0), hits).otherwise(F.array_repeat(F.lit(1.0), len(words)))

    return f

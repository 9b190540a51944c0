"""Retrieval metrics as joins of a run ``(query_id, case_id, sim)`` with judgements ``(query_id, case_id, rel)``.

Only queries that both have count. Ties of the run are broken by ``case_id``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import stored
from .retrieval import Result, Step

DEFAULT = ("precision", "recall", "f1", "map", "ndcg")


def parse_metric(spec: str) -> tuple[str, int, int]:
    """``name[@k][-lN]``: name, cut-off (0: none) and the least relevance that counts (1)."""
    m = re.fullmatch(r"(.+?)(?:@(\d+))?(?:-l(\d+))?", spec)
    return m[1], int(m[2] or 0), int(m[3] or 1)


def generate_metric(name: str, k: int = 0, level: int = 1) -> str:
    return name + (f"@{k}" if k else "") + (f"-l{level}" if level != 1 else "")


def generate_metrics(names: Sequence[str] = DEFAULT, ks: Sequence[int] | int = 0, levels: Sequence[int] | int = 1) -> list[str]:
    seq = lambda v: [v] if isinstance(v, int) else list(v)
    return [generate_metric(n, k, v) for n, k, v in product(names, seq(ks), seq(levels))]


def _shared(qrels: DataFrame, run: DataFrame) -> tuple[DataFrame, DataFrame]:
    return qrels.join(run.select("query_id").distinct(), "query_id", "left_semi"), run.join(qrels.select("query_id").distinct(), "query_id", "left_semi")


def _ranked(run: DataFrame) -> DataFrame:
    return run.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sim"), "case_id")))


#: Places of the ideal ranking in one row while it is summed.
_PLACES = 10_000


def _ideal(judged: DataFrame, k: int, level: int) -> DataFrame:
    """``(query_id, idcg)`` of the judgements in falling relevance, the first ``k`` or all.

    Equal judgements are counted, not ranked one by one: a query's cases are never brought to one task.
    """
    counted = judged.where(F.col("rel") >= level).groupBy("query_id", "rel").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("query_id").orderBy(F.desc("rel")))
    placed = counted.withColumn("last", upto).withColumn("first", F.col("last") - F.col("n") + 1)
    if k:
        placed = placed.where(F.col("first") <= k).withColumn("last", F.least("last", F.lit(k).cast("bigint")))
    runs = placed.withColumn("at", F.explode(F.sequence(F.col("first"), F.col("last"), F.lit(_PLACES).cast("bigint"))))
    places = runs.select("query_id", "rel", F.explode(F.sequence(F.col("at"), F.least(F.col("at") + _PLACES - 1, F.col("last")))).alias("place"))
    return places.groupBy("query_id").agg(F.sum(F.col("rel") / F.log2(F.col("place") + 1)).alias("idcg"))


def per_query(qrels: DataFrame, run: DataFrame, k: int = 0, level: int = 1) -> DataFrame:
    """``(query_id, precision, recall, f1, map, ndcg, hits, hit_rate, mrr)`` with binary relevance; nDCG with linear gain and log2."""
    qrels, run = _shared(qrels, run)
    judged = qrels.withColumn("good", (F.col("rel") >= level).cast("int"))
    ranked = _ranked(run)
    if k:
        ranked = ranked.where(F.col("rank") <= k)
    found = ranked.join(judged, ["query_id", "case_id"], "left").select("query_id", "rank", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("rel", F.lit(0)).alias("rel"))
    upto = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    gain = lambda c, r: F.when(F.col(c) >= level, F.col(c)).otherwise(0) / F.log2(F.col(r) + 1)
    got = found.withColumn("so_far", F.sum("good").over(upto)).groupBy("query_id").agg(
        F.count("*").alias("n"), F.sum("good").alias("hits"), F.sum(F.col("good") * F.col("so_far") / F.col("rank")).alias("ap"),
        F.sum(gain("rel", "rank")).alias("dcg"), F.min(F.when(F.col("good") == 1, F.col("rank"))).alias("first"),
    )
    ideal = judged.groupBy("query_id").agg(F.sum("good").alias("relevant")).join(_ideal(judged, k, level), "query_id", "left").fillna(0.0, ["idcg"])
    out = ideal.join(got, "query_id", "left").fillna(0, ["n", "hits", "ap", "dcg"])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = ratio(F.col("hits"), F.lit(k) if k else F.col("n")), ratio(F.col("hits"), F.col("relevant"))
    return out.select(
        "query_id", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"), ratio(F.col("ap"), F.col("relevant")).alias("map"),
        ratio(F.col("dcg"), F.col("idcg")).alias("ndcg"), F.col("hits").cast("double").alias("hits"), (F.col("hits") > 0).cast("double").alias("hit_rate"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"),
    )


def concordances(qrels: DataFrame, run: DataFrame, k: int = 0) -> DataFrame:
    """``(query_id, concordant, discordant, total)`` over pairs of judged cases of different relevance.

    A pair counts as concordant or discordant if both are in the top ``k``; equal scores are discordant.
    """
    qrels, run = _shared(qrels, run)
    ranked = _ranked(run)
    if k:
        ranked = ranked.where(F.col("rank") <= k)
    scored = qrels.join(ranked.select("query_id", "case_id", "sim"), ["query_id", "case_id"], "left")
    counted = stored(scored.groupBy("query_id", "rel", "sim").agg(F.count("*").alias("n")))
    pairs = _dominance(counted.where("sim is not null"))
    total = counted.groupBy("query_id", "rel").agg(F.sum("n").alias("n")).groupBy("query_id").agg(_unequal("n").alias("total"))
    out = total.join(pairs, "query_id", "left").fillna(0)
    return out.select("query_id", "concordant", (F.col("reversed") + F.col("tied")).alias("discordant"), "total")


def _unequal(n: str) -> Column:
    """Pairs of rows from different groups, given the sizes ``n`` of the groups."""
    return ((F.sum(n) * F.sum(n) - F.sum(F.col(n) * F.col(n))) / 2).cast("bigint")


def _dominance(counted: DataFrame) -> DataFrame:
    """``(query_id, concordant, reversed, tied)``: pairs of unequal relevance by the order of their scores.

    ``counted`` has rows ``(query_id, rel, sim, n)``: pairs are made of distinct values, weighed by how often they occur.
    """
    other = counted.select("query_id", F.col("rel").alias("r2"), F.col("sim").alias("s2"), F.col("n").alias("n2"))
    both = counted.join(other, "query_id").where("rel > r2")
    weight = F.col("n") * F.col("n2")
    sums = {"concordant": F.col("sim") > F.col("s2"), "reversed": F.col("sim") < F.col("s2"), "tied": F.col("sim") == F.col("s2")}
    return both.groupBy("query_id").agg(*(F.sum(F.when(when, weight).otherwise(0)).alias(k) for k, when in sums.items()))


def correctness(qrels: DataFrame, run: DataFrame, k: int = 0) -> DataFrame:
    c, d = F.col("concordant"), F.col("discordant")
    return concordances(qrels, run, k).agg(F.avg(F.when(c + d > 0, (c - d) / (c + d)).otherwise(0.0)).alias("correctness"))


def completeness(qrels: DataFrame, run: DataFrame, k: int = 0) -> DataFrame:
    c, d, t = F.col("concordant"), F.col("discordant"), F.col("total")
    return concordances(qrels, run, k).agg(F.avg(F.when(t > 0, (c + d) / t).otherwise(0.0)).alias("completeness"))


def mean_score(run: DataFrame, k: int = 0) -> DataFrame:
    ranked = _ranked(run)
    if k:
        ranked = ranked.where(F.col("rank") <= k)
    return ranked.groupBy("query_id").agg(F.avg("sim").alias("m")).agg(F.avg("m").alias("mean_score"))


def kendall_tau(qrels: DataFrame, run: DataFrame, k: int = 0, level: int = 1) -> DataFrame:
    """Mean tau-b over queries of the judged cases in the top ``k``; queries with fewer than two are left out."""
    qrels, run = _shared(qrels, run)
    ranked = _ranked(run)
    if k:
        ranked = ranked.where(F.col("rank") <= k)
    scored = ranked.join(qrels.where(F.col("rel") >= level), ["query_id", "case_id"])
    counted = stored(scored.groupBy("query_id", "rel", "sim").agg(F.count("*").alias("n")))
    sizes = lambda c, name: counted.groupBy("query_id", c).agg(F.sum("n").alias("n")).groupBy("query_id").agg(_unequal("n").alias(name))
    of = counted.groupBy("query_id").agg(F.sum("n").alias("rows")).where("rows > 1").join(sizes("sim", "na"), "query_id").join(sizes("rel", "nb"), "query_id").join(_dominance(counted), "query_id", "left").fillna(0)
    s = F.col("concordant") - F.col("reversed")
    return of.select((s / F.sqrt(F.when((F.col("na") > 0) & (F.col("nb") > 0), F.col("na").cast("double") * F.col("nb")))).alias("t")).agg(F.avg("t").alias("kendall_tau"))


def score_metric(qrels: DataFrame, run: DataFrame, function: Callable[[list, list], float], name: str = "score") -> DataFrame:
    """Mean over queries of a Python function of the aligned lists of judgements and scores."""

    @F.pandas_udf("double")
    def apply(rel: pd.Series, sim: pd.Series) -> pd.Series:
        return pd.Series([float(function(list(a), list(b))) for a, b in zip(rel, sim)])

    both = qrels.join(run, ["query_id", "case_id"])
    lists = both.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("case_id", "rel", "sim"))).alias("v"))
    return lists.select(apply(F.col("v.rel"), F.col("v.sim")).alias("m")).agg(F.avg("m").alias(name))


_OWN = {"correctness": lambda q, r, k, v: correctness(q, r, k), "completeness": lambda q, r, k, v: completeness(q, r, k), "mean_score": lambda q, r, k, v: mean_score(_shared(q, r)[1], k), "kendall_tau": kendall_tau}


def compute(qrels: DataFrame, run: DataFrame, metrics: Sequence[str] = DEFAULT) -> DataFrame:
    """``(metric, value)``, one row for each; metrics of one cut-off and level share a plan."""
    out, groups = None, {}
    for m in metrics:
        name, k, level = parse_metric(m)
        groups.setdefault((k, level), []).append((name, m))
    for (k, level), names in groups.items():
        plain = [(n, m) for n, m in names if n not in _OWN]
        parts = []
        if plain:
            means = per_query(qrels, run, k, level).agg(*(F.avg(n).alias(m) for n, m in plain))
            parts.append(means.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"`{m}`").alias("value")) for _, m in plain))).alias("r")).select("r.*"))
        parts += [_OWN[n](qrels, run, k, level).select(F.lit(m).alias("metric"), F.col(n).alias("value")) for n, m in names if n in _OWN]
        for part in parts:
            out = part if out is None else out.unionByName(part)
    return out


def normalized(value: Column, low: Column, high: Column) -> Column:
    """``value`` from the range ``low`` to ``high`` brought to 0 to 1; 0 where both are equal."""
    return F.when(high == low, 0.0).otherwise((value - low) / (high - low))


def scaled(value: Column, low: float, high: float) -> Column:
    """``value`` from 0 to 1 brought to ``low`` to ``high``."""
    return value * (high - low) + low


def normalize_and_scale(value: Column, low: Column, high: Column, to_low: float, to_high: float) -> Column:
    return scaled(normalized(value, low, high), to_low, to_high)


def rounded(value: Column, mode: str = "nearest") -> Column:
    """Whole numbers: the ``floor``, the ``ceil``, or the ``nearest``, upwards on a tie."""
    if mode not in ("floor", "ceil", "nearest"):
        raise ValueError(f"unknown mode of rounding: {mode}")
    return {"nearest": F.floor(value + 0.5), "floor": F.floor(value), "ceil": F.ceil(value)}[mode].cast("int")


def similarities_to_qrels(scores: DataFrame, max_qrel: int | None = None, min_qrel: int = 1, auto_scale: bool = True, round_mode: str = "nearest") -> DataFrame:
    """Judgements from scores: without ``max_qrel`` reversed ranks from ``min_qrel``, else scaled over all scores and rounded."""
    if max_qrel is None:
        place = F.row_number().over(Window.partitionBy("query_id").orderBy("sim", F.desc("case_id")))
        return scores.select("query_id", "case_id", (place - 1 + min_qrel).cast("int").alias("rel"))
    unit = F.col("sim")
    if auto_scale:
        scores = scores.crossJoin(F.broadcast(scores.agg(F.min("sim").alias("lo"), F.max("sim").alias("hi"))))
        unit = normalized(F.col("sim"), F.col("lo"), F.col("hi"))
    return scores.select("query_id", "case_id", rounded(scaled(unit, min_qrel, max_qrel), round_mode).alias("rel"))


def step_to_qrels(step: Step, **how) -> DataFrame:
    """Judgements from the scores of one step of a retrieval."""
    return similarities_to_qrels(step.similarities(), **how)


def retrieval_to_qrels(result: Result, max_qrel: int | None = 5, **how) -> list[DataFrame]:
    """Judgements from each step of a retrieval."""
    return [step_to_qrels(s, max_qrel=max_qrel, **how) for s in result.steps]


def step_metrics(qrels: DataFrame, step: Step, metrics: Sequence[str] = DEFAULT) -> DataFrame:
    return compute(qrels, step.similarities(), metrics)


def retrieval_metrics(qrels: DataFrame, result: Result, metrics: Sequence[str] = DEFAULT) -> DataFrame:
    """``(step, metric, value)`` of each step of a retrieval, steps counted from 0."""
    out = None
    for i, step in enumerate(result.steps):
        part = step_metrics(qrels, step, metrics).select(F.lit(i).alias("step"), "metric", "value")
        out = part if out is None else out.unionByName(part)
    return out

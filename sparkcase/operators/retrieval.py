"""Retrieval: pairs of cases and queries, their similarity, and the ranking of each query.

Cases have the columns ``case_id`` and ``case`` (any type), and ``ord``, their order of insertion, which breaks ties;
queries ``query_id`` and ``query``. Scores are rows ``(query_id, case_id, ord, sim, case, query)``. Queries are
broadcast while their measured size in rows and bytes allows it, cases never.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.measures import Measure, value_of
from ..functions.pooling import aggregator
from ..plans.filters import compile_filter
from ..sources.store import stored

#: Most rows, and bytes of them as JSON, that are broadcast; more are joined without a hint.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 64 << 20
#: About so many pairs are made, and sorted for a ranking, by one task, with at most so many tasks.
TASK_PAIRS, TASKS = 500_000, 20_000
#: A shuffle to at most so many tasks (Spark's default) writes rows as they come; to more, a writer first holds what it reads.
UNSORTED = 200
#: So many groups of tasks are ranked before all of a query.
GROUPS = 32

Retriever = Callable[[DataFrame], DataFrame]


def cases_of(df: DataFrame, key: str, columns: Sequence[str] | None = None, order: str | None = None) -> DataFrame:
    """``df`` as cases: ``columns`` (all but the key) in the struct ``case``; the order is that of ``order``, or the key's."""
    columns = columns or [c for c in df.columns if c != key]
    return df.select(F.col(key).alias("case_id"), F.col(order or key).alias("ord"), F.struct(*columns).alias("case"))


def queries_of(df: DataFrame, key: str, columns: Sequence[str] | None = None) -> DataFrame:
    columns = columns or [c for c in df.columns if c != key]
    return df.select(F.col(key).alias("query_id"), F.struct(*columns).alias("query"))


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows and ``bytes`` bytes, counted no further than that."""
    return _counted(df, rows, bytes)[0]


def _counted(df: DataFrame, rows: int = BROADCAST_ROWS, bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, int | None]:
    """As ``broadcast_if_small``, and the number of rows; none if there is no hint."""
    n, size = df.limit(rows + 1).select(F.octet_length(F.to_json(F.struct(*df.columns))).alias("b")).agg(F.count("*"), F.sum(F.coalesce("b", F.lit(0)))).first()
    return (F.broadcast(df), n) if n <= rows and (size or 0) <= bytes else (df, None)


def crossed(cases: DataFrame, queries: DataFrame) -> DataFrame:
    """Every case with every query. Cases are dealt by key to as many tasks as keep each near ``TASK_PAIRS`` pairs, so
    that what a task sorts does not grow with the input; a table of few files would else be one task."""
    other, n = _counted(queries)
    if n:
        rows = cases.count()
        cases = dealt(cases, rows, min(-(-rows * n // TASK_PAIRS), TASKS))
    return cases.crossJoin(other)


def dealt(cases: DataFrame, rows: int, tasks: int) -> DataFrame:
    """``cases`` dealt by key to so many tasks. To many they go in two steps, so that no writer holds all of a large file."""
    if tasks <= UNSORTED:
        return cases.repartition(tasks, "case_id") if tasks > 1 else cases
    parts = min(-(-rows // TASK_PAIRS), UNSORTED)
    # Hashed otherwise than in the first step; the column between them also keeps the optimizer from making them one.
    return cases.repartition(parts, "case_id").withColumn("deal__", F.xxhash64("case_id")).repartition(tasks, "deal__").drop("deal__")


def pairs(cases: DataFrame, queries: DataFrame, membership: DataFrame | None = None, on: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Every case with every query; with ``membership`` only its ``(query_id, case_id)``; with ``on`` only where it holds.

    An equality in ``on`` becomes an equi-join, so pruned pairs are never made.
    """
    if membership is not None:
        out = membership.select("query_id", "case_id").join(cases, "case_id").join(queries, "query_id")
        return out.where(on(F.col("case"), F.col("query"))) if on else out
    return cases.join(broadcast_if_small(queries), on(cases["case"], queries["query"])) if on else crossed(cases, queries)


def score(paired: DataFrame, measure: Measure) -> DataFrame:
    """Adds ``sim``, and ``detail`` where the measure gives more than a number."""
    raw = measure(F.col("case"), F.col("query"))
    if getattr(measure, "structured", False):
        return paired.withColumn("detail", raw).withColumn("sim", F.col("detail.value"))
    return paired.withColumn("sim", raw)


def build(measure: Measure, on: Callable[[Column, Column], Column] | None = None) -> Retriever:
    """A retriever of pairs: scores whatever pairs it is given."""

    def run(paired: DataFrame) -> DataFrame:
        kept = paired.where(on(F.col("case"), F.col("query"))) if on else paired
        return score(kept.drop("sim", "detail", "rank"), measure)

    return run


def rank(scores: DataFrame) -> DataFrame:
    """Adds ``rank``, from 1: falling similarity, ties by order."""
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sim"), "ord")))


def first(scores: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` of each query with their ``rank``. Groups of tasks are ranked first, so that the last task has
    ``limit`` rows of each group instead of each task, however many tasks there are."""
    of = Window.partitionBy("query_id", "group__").orderBy(F.desc("sim"), "ord")
    grouped = scores.withColumn("group__", F.pmod(F.spark_partition_id(), F.lit(GROUPS)))
    return rank(grouped.withColumn("rank", F.row_number().over(of)).where(F.col("rank") <= limit).drop("group__")).where(F.col("rank") <= limit)


def dropout(retriever: Retriever, limit: int | None = None, min_similarity: float | None = None, max_similarity: float | None = None) -> Retriever:
    """Keeps scores within both bounds, bounds included, and the first ``limit`` of each query; the rank becomes the order."""

    def run(paired: DataFrame) -> DataFrame:
        out = retriever(paired)
        if min_similarity is not None:
            out = out.where(F.col("sim") >= min_similarity)
        if max_similarity is not None:
            out = out.where(F.col("sim") <= max_similarity)
        out = rank(out) if limit is None else first(out, limit)
        return out.withColumn("ord", F.col("rank").cast("long"))

    return run


def transpose(retriever: Retriever, to_case: Callable[[Column], Column], to_query: Callable[[Column], Column] | None = None) -> Retriever:
    """Retrieves over converted values and gives the original ones back."""

    def run(paired: DataFrame) -> DataFrame:
        kept = paired.withColumn("case_0", F.col("case")).withColumn("query_0", F.col("query"))
        kept = kept.withColumn("case", to_case(F.col("case_0"))).withColumn("query", (to_query or to_case)(F.col("query_0")))
        return retriever(kept).drop("case", "query").withColumnsRenamed({"case_0": "case", "query_0": "query"})

    return run


def combine(retrievers: Mapping[str, Retriever] | Sequence[Retriever], aggregate=None, strategy: str = "union", default_sim: float = 0.0) -> Retriever:
    """Joins the scores of several retrievers by query and case and aggregates them.

    ``union`` keeps a case that any retriever gave, with ``default_sim`` for the others; ``intersection`` only those
    that all gave. One aggregation by key, however many retrievers.
    """
    aggregate = aggregate or aggregator()
    named = retrievers if isinstance(retrievers, Mapping) else {str(i): r for i, r in enumerate(retrievers)}

    def run(paired: DataFrame) -> DataFrame:
        union = None
        for i, r in enumerate(named.values()):
            part = r(paired).select("query_id", "case_id", "ord", "case", "query", "sim", F.lit(i).alias("i"))
            union = part if union is None else union.unionByName(part)
        cells = [F.max(F.when(F.col("i") == i, F.col("sim"))).alias(f"s{i}") for i in range(len(named))]
        out = union.groupBy("query_id", "case_id").agg(F.min("ord").alias("ord"), F.max_by("case", "i").alias("case"), F.max_by("query", "i").alias("query"), F.count_distinct("i").alias("n"), *cells)
        if strategy == "intersection":
            out = out.where(F.col("n") == len(named))
        values = {k: F.coalesce(F.col(f"s{i}"), F.lit(float(default_sim))) for i, k in enumerate(named)}
        sim = aggregate(values if isinstance(retrievers, Mapping) else list(values.values()))
        return out.select("query_id", "case_id", "ord", "case", "query", sim.alias("sim"))

    return run


def reciprocal_rank_fusion(rankings: Sequence[DataFrame], k: int = 60, weights: Sequence[float] | None = None, limit: int | None = None) -> DataFrame:
    """``(query_id, case_id, ord, sim)``: each ranking adds ``weight / (k + rank)``; a case it lacks gets nothing from it."""
    weights = weights or [1.0] * len(rankings)
    union = None
    for w, scores in zip(weights, rankings):
        part = (scores if "rank" in scores.columns else rank(scores)).select("query_id", "case_id", "ord", (F.lit(float(w)) / (F.lit(k) + F.col("rank"))).alias("part"))
        union = part if union is None else union.unionByName(part)
    out = union.groupBy("query_id", "case_id").agg(F.min("ord").alias("ord"), F.sum("part").alias("sim"))
    return rank(out).where(F.col("rank") <= limit) if limit is not None else out


def normalize(scores: DataFrame) -> DataFrame:
    """Min-max scaling of each query's scores; equal scores all become 1."""
    of = Window.partitionBy("query_id")
    low, high = F.min("sim").over(of), F.max("sim").over(of)
    return scores.withColumn("lo", low).withColumn("hi", high).withColumn("sim", F.when(F.col("lo") == F.col("hi"), 1.0).otherwise((F.col("sim") - F.col("lo")) / (F.col("hi") - F.col("lo")))).drop("lo", "hi")


def chunk(cases: DataFrame, chunks: Callable[[Column], Column]) -> DataFrame:
    """Splits text cases: one case for each chunk, its key ``{key}-chunk{i}``."""
    parts = cases.select("case_id", "ord", F.posexplode(chunks(F.col("case"))).alias("i", "case"))
    return parts.select(F.concat(F.col("case_id").cast("string"), F.lit("-chunk"), F.col("i").cast("string")).alias("case_id"), F.struct("ord", "i").alias("ord"), "case")


def rerank(retriever: Retriever, scorer: Callable[[str, Sequence[str]], Sequence[float]], to_text: Callable[[Column], Column] = lambda c: c.cast("string")) -> Retriever:
    """Rescores each query's candidates with a Python scorer of ``(query text, case texts)``; a null score drops the case."""
    import pandas as pd

    def run(paired: DataFrame) -> DataFrame:
        found = stored(retriever(paired))  # read twice
        texts = found.select("query_id", "case_id", to_text(F.col("query")).alias("q"), to_text(F.col("case")).alias("c"))

        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"query_id": pdf.query_id, "case_id": pdf.case_id, "sim": list(scorer(pdf.q.iloc[0], list(pdf.c)))})

        kinds = {n: t for n, t in texts.dtypes}
        scored = texts.groupBy("query_id").applyInPandas(one, f"query_id {kinds['query_id']}, case_id {kinds['case_id']}, sim double")
        return found.drop("sim", "detail", "rank").join(scored.where("sim is not null and not isnan(sim)"), ["query_id", "case_id"])

    return run


def distinct_scores(paired: DataFrame, measure: Measure) -> DataFrame:
    """Scores every distinct ``(case, query)`` value once and joins the score back: for costly measures over few values."""
    values = paired.select("case", "query").distinct()
    return paired.join(score(values, measure).select(F.col("case").alias("c_"), F.col("query").alias("q_"), "sim"), F.col("case").eqNullSafe(F.col("c_")) & F.col("query").eqNullSafe(F.col("q_"))).drop("c_", "q_")


def linear_band(attribute: str, high: float, low: float, min_similarity: float) -> Callable[[Column, Column], Column]:
    """Join condition that a linear score of one attribute of at least ``min_similarity`` implies, as a bucketed band join.

    Use it as ``on`` of ``banded_pairs``.
    """
    reach = high - min_similarity * (high - low)
    return lambda case, query: F.abs(case[attribute] - query[attribute]) <= reach


#: Cells to the reach of a band join, most queries in one row of a cell, candidates of a task.
CELLS, MEMBERS, CANDIDATES = 16, 4096, 20_000_000


def banded_pairs(cases: DataFrame, queries: DataFrame, attribute: str, reach: float) -> DataFrame:
    """Pairs whose attributes differ by at most ``reach``, by an equi-join on cells narrower than it.

    The queries of a cell are kept as arrays in rows of bounded size; a case joins the rows of the cells around it, which
    are then unfolded, so nearly every candidate is a pair. Cases out of reach of all queries are not shuffled.
    """
    if reach <= 0:
        return pairs(cases, queries, on=lambda c, q: c[attribute] == q[attribute])
    width = reach / CELLS
    cell = lambda v: F.floor(F.greatest(F.least(v / width, F.lit(1e18)), F.lit(-1e18)))
    a, b = F.col("case")[attribute].cast("double"), F.col("query")[attribute].cast("double")
    right = queries.where(b.isNotNull() & ~F.isnan(b)).withColumn("cell", cell(b))
    n, cells, most, low, high = right.groupBy("cell").agg(F.count("*").alias("n"), F.min(b).alias("low"), F.max(b).alias("high")).agg(F.sum("n"), F.count("*"), F.max("n"), F.min("low"), F.max("high")).first()
    if not n:
        low = high = 0.0
    left = cases.where((a >= F.lit(low) - reach) & (a <= F.lit(high) + reach) & ~F.isnan(a))
    # A cell more on each side, as the division rounds.
    around = left.withColumn("cell", F.explode(F.sequence(cell(a - reach) - 1, cell(a + reach) + 1)))
    tasks = min(-(-left.count() * (2 * CELLS + 3) * (n or 0) // max(1, cells) // CANDIDATES), TASKS, cells) or 1
    block = F.pmod(F.xxhash64("query_id"), F.lit(-(-(most or 1) // MEMBERS)))
    members = right.groupBy("cell", block.alias("block")).agg(F.collect_list(F.struct(*queries.columns)).alias("members")).drop("block")
    joined = around.repartition(tasks, "cell").join(members.repartition(tasks, "cell"), "cell").select(*cases.columns, F.explode("members").alias("member"))
    out = joined.select(*cases.columns, *(F.col("member")[c].alias(c) for c in queries.columns))
    return out.where(F.abs(F.col("case")[attribute] - F.col("query")[attribute]) <= reach)


@dataclass
class Step:
    """One step's scores, with lazily made views of them."""

    scores: DataFrame

    @property
    def ranking(self) -> DataFrame:
        return rank(self.scores)

    def similarities(self) -> DataFrame:
        return self.scores.select("query_id", "case_id", "sim")

    def without_values(self) -> Step:
        return Step(self.scores.drop("case", "query"))


@dataclass
class Result:
    """Steps of a chain of retrievers or of a phase."""

    steps: list[Step] = field(default_factory=list)

    @property
    def final(self) -> DataFrame:
        return self.steps[-1].ranking


def apply_pairs(paired: DataFrame, retrievers: Retriever | Sequence[Retriever]) -> Result:
    """Runs retrievers one after another; each sees the pairs that the last one kept, in the order that it gave."""
    steps = []
    for r in [retrievers] if callable(retrievers) else retrievers:
        paired = r(paired)
        steps.append(Step(paired))
    return Result(steps)


def apply_queries(cases: DataFrame, queries: DataFrame, retrievers, where=None, membership: DataFrame | None = None) -> Result:
    if where is not None:
        cases = cases.where(compile_filter(where))
    return apply_pairs(pairs(cases, queries, membership), retrievers)


def apply_query(cases: DataFrame, query: Mapping, retrievers, schema: str, where=None) -> Result:
    """As ``apply_queries`` for one record of the given schema."""
    row = cases.sparkSession.createDataFrame([(0, tuple(query[k] for k in query))], f"query_id int, query struct<{schema}>")
    return apply_queries(cases, row, retrievers, where)

"""Reuse, revise and retain over scored pairs, the full cycle and a system that binds them."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.measures import Measure
from ..sources.store import stored
from . import retrieval
from .adapt import Adaptation
from .index import ParquetIndex
from .retrieval import Result, Retriever, Step, build, score

Phase = Callable[[DataFrame], DataFrame]


def reuse(adaptation: Adaptation | None, measure: Measure) -> Phase:
    """Adapts each case to its query, then scores the adapted pairs."""

    def run(scores: DataFrame) -> DataFrame:
        adapted = scores if adaptation is None else scores.withColumn("case", adaptation(F.col("case"), F.col("query")))
        return build(measure)(adapted)

    return run


revise = reuse


def reuse_groups(function: Callable[[pd.DataFrame], pd.DataFrame], schema: str, measure: Measure) -> Phase:
    """Adapts all cases of a query together: ``function`` gets its ``(query_id, case_id, ord, case, query)`` rows, a map or a reduction."""

    def run(scores: DataFrame) -> DataFrame:
        rows = scores.select("query_id", "case_id", "ord", "case", "query")
        return build(measure)(rows.groupBy("query_id").applyInPandas(function, schema))

    return run


def retain(cases: DataFrame, measure: Measure, new: Callable[[DataFrame], DataFrame] | None = None) -> Phase:
    """Adds the pipeline's values to the stored cases under new keys, then scores the whole against each query.

    New keys follow the greatest one, in the order of query and rank; ``new`` replaces that numbering.
    """

    def run(scores: DataFrame) -> DataFrame:
        added = (new or numbered(cases))(scores)
        queries = scores.select("query_id", "query").dropDuplicates(["query_id"])
        old = cases.select("case_id", "ord", "case").crossJoin(retrieval.broadcast_if_small(queries)).withColumn("is_new", F.lit(False))
        return score(old.unionByName(added.withColumn("is_new", F.lit(True))), measure)

    return run


def numbered(cases: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """New keys for each query's rows: the greatest stored key plus the row's place among the query's rows."""

    def run(scores: DataFrame) -> DataFrame:
        last = cases.agg(F.coalesce(F.max("case_id"), F.lit(-1)).alias("last_key"), F.coalesce(F.max("ord"), F.lit(-1)).alias("last_ord"))
        place = F.row_number().over(Window.partitionBy("query_id").orderBy("ord"))
        return scores.withColumn("place", place).crossJoin(F.broadcast(last)).select(
            (F.col("last_key") + F.col("place")).cast(cases.schema["case_id"].dataType).alias("case_id"), (F.col("last_ord") + F.col("place")).cast(cases.schema["ord"].dataType).alias("ord"), "case", "query_id", "query"
        )

    return run


def retain_indexed(index: ParquetIndex, measure: Measure, columns: Sequence[str]) -> Phase:
    """Stores the pipeline's values in an index under new keys, then scores the index's cases against each query.

    Keys are whole numbers; new ones follow the greatest, in the order of query and rank. A query sees the cases that
    were there before, its own and those of the queries before it. Rows that a later dropout removes stay in the index.
    """

    def run(scores: DataFrame) -> DataFrame:
        old = index.read()
        kind = old.schema[index.key].dataType
        last = old.agg(F.coalesce(F.max(index.key), F.lit(-1).cast(kind))).first()[0]
        # One row a query: how many new cases the queries before it have.
        before = scores.groupBy("query_id").count().withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("query_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        place = F.row_number().over(Window.partitionBy("query_id").orderBy("ord"))
        added = scores.withColumn("place", place).join(retrieval.broadcast_if_small(before), "query_id")
        added = stored(added.select((F.lit(last) + F.col("before") + F.col("place")).cast(kind).alias("case_id"), "case", F.col("query_id").alias("by")))
        queries = stored(scores.select("query_id", "query").dropDuplicates(["query_id"]))
        known = retrieval.cases_of(stored(old), index.key, columns)
        index.upsert(added.select(F.col("case_id").alias(index.key), *(F.col("case")[c].alias(c) for c in columns)))
        few = retrieval.broadcast_if_small(queries)
        before = known.crossJoin(few).select("case_id", "ord", "case", "query_id", "query", F.lit(False).alias("is_new"))
        own = added.join(few, F.col("by") <= F.col("query_id")).select("case_id", F.col("case_id").alias("ord"), F.struct(*(F.col("case")[c].alias(c) for c in columns)).alias("case"), "query_id", "query", (F.col("by") == F.col("query_id")).alias("is_new"))
        return score(before.unionByName(own), measure)

    return run


def retain_dropout(phase: Phase, min_similarity: float | None = None, max_similarity: float | None = None) -> Phase:
    """Drops newly added rows outside the bounds; stored ones stay."""

    def run(scores: DataFrame) -> DataFrame:
        out, outside = phase(scores), F.lit(False)
        if min_similarity is not None:
            outside = outside | (F.col("sim") < min_similarity)
        if max_similarity is not None:
            outside = outside | (F.col("sim") > max_similarity)
        return out.where(~(F.col("is_new") & outside))

    return run


def apply_phase(scores: DataFrame, phases: Phase | Sequence[Phase]) -> Result:
    """Phases of one kind in turn; none passes the scores through."""
    steps = []
    for phase in [phases] if callable(phases) else phases:
        scores = phase(scores)
        steps.append(Step(scores))
    return Result(steps or [Step(scores)])


@dataclass
class CycleResult:
    retrieval: Result
    reuse: Result
    revise: Result
    retain: Result

    @property
    def final(self) -> DataFrame:
        return self.retain.final


def cycle(cases: DataFrame, queries: DataFrame, retrievers, reusers=(), revisers=(), retainers=()) -> CycleResult:
    """Retrieve, reuse, revise, retain; each phase starts from the last step of the one before."""
    found = retrieval.apply_queries(cases, queries, retrievers)
    reused = apply_phase(found.steps[-1].scores, reusers)
    revised = apply_phase(reused.steps[-1].scores, revisers)
    return CycleResult(found, reused, revised, apply_phase(revised.steps[-1].scores, retainers))


@dataclass
class System:
    """Cases with named phases; a call may restrict the cases to some keys or bring its own."""

    cases: DataFrame
    retrievers: Mapping[str, Retriever] = field(default_factory=dict)
    reusers: Mapping[str, Phase] = field(default_factory=dict)
    revisers: Mapping[str, Phase] = field(default_factory=dict)
    retainers: Mapping[str, Phase] = field(default_factory=dict)

    def casebase(self, spec: DataFrame | Sequence | None = None) -> DataFrame:
        if spec is None:
            return self.cases
        if isinstance(spec, DataFrame):
            return spec
        keys = self.cases.sparkSession.createDataFrame([(k,) for k in spec], f"case_id {self.cases.schema['case_id'].dataType.simpleString()}")
        return self.cases.join(keys, "case_id", "left_semi")

    def retrieve(self, queries: DataFrame, spec=None, names: Sequence[str] | None = None) -> Result:
        return retrieval.apply_queries(self.casebase(spec), queries, [self.retrievers[n] for n in names or self.retrievers])

    def cycle(self, queries: DataFrame, spec=None) -> CycleResult:
        return cycle(self.casebase(spec), queries, *(list(x.values()) for x in (self.retrievers, self.reusers, self.revisers, self.retainers)))

"""Retrieval from an index: cases that are kept between calls, searched by measure, by vector, by terms or by both."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import index as search, retrieval
from .index import ParquetIndex


def resolve_cases(cases: DataFrame | None, index: ParquetIndex, columns: Sequence[str] | None = None) -> DataFrame:
    """The given cases; those of the index where none are given, or an empty table. Without an index that is an error."""
    if cases is not None and cases.limit(1).count():
        return cases
    if not index.has_index():
        raise ValueError("no cases are given and there is no index: call put first")
    return retrieval.cases_of(index.read(), index.key, columns)


class Persisted:
    """Retrievers over the cases of an index, which its own methods change."""

    def __init__(self, retrievers, index: ParquetIndex, columns: Sequence[str] | None = None):
        self.retrievers, self.index, self.columns = retrievers, index, columns

    def apply_queries(self, queries: DataFrame, cases: DataFrame | None = None, where=None) -> retrieval.Result:
        return retrieval.apply_queries(resolve_cases(cases, self.index, self.columns), queries, self.retrievers, where)


class StorageRetriever:
    """Dense, sparse or hybrid search of text queries ``(query_id, text)`` in an index of ``(key, value[, vector])``.

    ``embed`` turns texts into vectors when rows are put, so vectors are computed once and stay in step with the index;
    ``query_embed`` does so for queries, by default alike. Cases of a call are ranked without the index, densely only.
    ``where`` filters the index; ``normalized`` scales each query's scores to 0 to 1.
    """

    def __init__(
        self, index: ParquetIndex, kind: str = "dense", embed: Callable[[Column], Column] | None = None, query_embed: Callable[[Column], Column] | None = None, limit: int | None = None, metric: str = "cosine", where=None, normalized: bool = True, oversample: int = 4, k: int = 60, weights: tuple[float, float] = (0.7, 0.3)
    ):
        if kind not in ("dense", "sparse", "hybrid"):
            raise ValueError(f"unknown kind of search: {kind}")
        if kind != "sparse" and embed is None:
            raise ValueError("dense and hybrid search need an embedder")
        if kind == "hybrid" and limit is None:
            raise ValueError("hybrid search needs a limit")
        self.index, self.kind, self.embed, self.query_embed, self.limit, self.metric = index, kind, embed, query_embed or embed, limit, metric
        self.where, self.normalized, self.oversample, self.k, self.weights = where, normalized, oversample, k, weights

    def rows(self, texts: DataFrame) -> DataFrame:
        """``(key, value, ...)`` with the vector that the index keeps."""
        return texts if self.embed is None else texts.withColumn("vector", self.embed(F.col("value")))

    def put(self, texts: DataFrame) -> None:
        self.index.put(self.rows(texts))

    def upsert(self, texts: DataFrame) -> None:
        self.index.upsert(self.rows(texts))

    def delete(self, keys: DataFrame) -> None:
        self.index.delete(keys)

    def apply_queries(self, queries: DataFrame, cases: DataFrame | None = None) -> DataFrame:
        """``(query_id, case_id, ord, sim, rank)``; ``cases`` are ``(key, value)``."""
        if cases is not None and cases.limit(1).count():
            if self.kind != "dense":
                raise ValueError(f"{self.kind} search needs an index: call put first")
            found = self.rows(cases)
        elif self.index.has_index():
            found = self.index.read()
        else:
            raise ValueError("no cases are given and there is no index: call put first")
        if self.where is not None:
            found = found.where(search.compile_filter(self.where))
        found = found.withColumns({"case_id": F.col(f"`{self.index.key}`"), "ord": F.col(f"`{self.index.key}`"), "text": F.col("value")})
        scores = []
        if self.kind != "sparse":
            scores.append(search.dense(found, queries.withColumn("vector", self.query_embed(F.col("text"))), self.metric))
        if self.kind != "dense":
            scores.append(search.bm25(found.select("case_id", "ord", "text"), queries, every=False, normalized=False))
        if self.kind == "hybrid":
            top = [retrieval.rank(s).where(F.col("rank") <= self.limit * self.oversample) for s in scores]
            out = retrieval.reciprocal_rank_fusion(top, self.k, self.weights, self.limit)
        else:
            out = retrieval.rank(scores[0])
            out = out if self.limit is None else out.where(F.col("rank") <= self.limit)
        return retrieval.normalize(out) if self.normalized else out

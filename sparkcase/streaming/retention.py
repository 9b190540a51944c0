"""Streams of queries or cases: the batch operators over unbounded input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.measures import Measure
from ..operators.index import ParquetIndex
from ..operators.retrieval import broadcast_if_small, score


def score_stream(queries: DataFrame, cases: DataFrame, measure: Measure, min_similarity: float = 0.0) -> DataFrame:
    """Pairs of streamed queries with a static case table whose score reaches the bound; stateless, so any output mode works."""
    return score(queries.crossJoin(broadcast_if_small(cases)), measure).where(F.col("sim") >= min_similarity)


def retain_stream(rows: DataFrame, index: ParquetIndex, checkpoint: str, **trigger) -> StreamingQuery:
    """Upserts every micro-batch into the index; of rows with one key the last by ``ord`` stays.

    A batch that is run again after a failure writes the same rows, so the index ends up as if it had run once.
    """

    def write(batch: DataFrame, _: int) -> None:
        if batch.limit(1).count():
            last = batch.groupBy(index.key).agg(F.max_by(F.struct(*batch.columns), "ord").alias("r")).select("r.*")
            index.upsert(last)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_counts(events: DataFrame, time: str = "ts", delay: str = "10 minutes", window: str = "5 minutes", *keys: str) -> DataFrame:
    """Counts by time window and keys with a watermark: state older than ``delay`` is dropped."""
    return events.withWatermark(time, delay).groupBy(F.window(time, window), *keys).count()

"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table, in bytes as measured, that an operator hands to every executor.
BROADCAST_LIMIT = 64 << 20


def bound_batches(spark: SparkSession, rows: int = 512) -> None:
    """Lowers the session's rows per Arrow batch to ``rows``: long texts would make batches of the default too large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which every executor shares.

    Where the session names none, a local session gets a temporary folder; on a cluster that is an error, as a
    folder of one machine would not be seen by the others.
    """
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if where:
        return where.rstrip("/")
    if not (sc.master.startswith("local[") or sc.master == "local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir().rstrip("/")


def stored(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fits(df: DataFrame, bytes_per_row: int, limit: int = BROADCAST_LIMIT) -> bool:
    """Whether the counted rows of a stored table stay under ``limit`` bytes."""
    return df.count() * bytes_per_row <= limit


def sized(df: DataFrame, bytes_per_row: int, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """``df`` with a broadcast hint if its counted size allows it; else as it is, for a shuffled join."""
    return F.broadcast(df) if fits(df, bytes_per_row, limit) else df


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have, compared as Spark does, without case."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name += "_"
    return name


def give_back() -> None:
    """Returns freed memory to the machine: Python workers live on from task to task, next to the executor's own heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(batches, limit: int = 4 << 20):
    """Cuts Arrow batches so that each piece holds at most ``limit`` bytes, or a single row."""
    for batch in batches:
        rows = max(1, int(batch.num_rows * limit / max(1, batch.nbytes)))
        for start in range(0, batch.num_rows, rows):
            piece = batch.slice(start, rows)
            if rows > 1 and pa.Table.from_batches([piece]).nbytes > 4 * limit:
                yield from (piece.slice(i, 1) for i in range(piece.num_rows))
            else:
                yield piece
    give_back()


def token_hashes(text, seed: int = 42):
    """64-bit hashes of the lower-cased words (runs of letters and digits) of a text column, in order."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w, F.lit(seed)))

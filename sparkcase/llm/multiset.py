"""Homomorphic multiset fingerprints: 1024 lanes of 16 bits, hashed from each paragraph and summed modulo 2^16.

A paragraph's vector is the SHA-256 of the paragraph behind each of 64 counters, so SQL can say it too.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, slices

LANES = 1024
EMPTY = bytes(2 * LANES)
_COUNTERS = [str(i).encode() for i in range(2 * LANES // 32)]


def paragraphs(text: str) -> list[str]:
    """Lines with inner white space made single; blank lines are no paragraphs."""
    return [p for p in (" ".join(line.split()) for line in text.split("\n")) if p]


def element(paragraph: str) -> np.ndarray:
    raw = b":" + paragraph.encode("utf-8", "surrogatepass")
    return np.frombuffer(b"".join(hashlib.sha256(c + raw).digest() for c in _COUNTERS), "<u2")


def of(items) -> bytes:
    """Fingerprint of a multiset of paragraphs."""
    total = np.zeros(LANES, np.uint16)
    for x in items:
        total += element(x)
    return total.astype("<u2").tobytes()


def insert(fingerprint: bytes, paragraph: str) -> bytes:
    return (np.frombuffer(fingerprint, "<u2") + element(paragraph)).astype("<u2").tobytes()


def delete(fingerprint: bytes, paragraph: str) -> bytes:
    return (np.frombuffer(fingerprint, "<u2") - element(paragraph)).astype("<u2").tobytes()


def merge(a: bytes, b: bytes) -> bytes:
    """Fingerprint of the union of two multisets, counts added."""
    return (np.frombuffer(a, "<u2") + np.frombuffer(b, "<u2")).astype("<u2").tobytes()


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, n_paragraphs, fingerprint, digest)``: the summed vector (2048 bytes) and its SHA-256 in hex.

    Two texts with the same paragraphs in any order, each as often, have equal fingerprints. A null text gives nulls,
    an empty or blank one the zero vector, an empty table no rows; a text of any length is taken whole. Every row
    gives a row, repeated ones too; other columns are dropped.
    """
    bound_batches(docs.sparkSession)
    kind = docs.schema[id].dataType.simpleString()

    def run(batches):
        for batch in slices(batches):
            n, vectors, digests = [], [], []
            for t in batch.column(1).to_pylist():
                items = None if t is None else paragraphs(t)
                v = None if t is None else of(items)
                n.append(None if t is None else len(items))
                vectors.append(v)
                digests.append(None if t is None else hashlib.sha256(v).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), pa.array(vectors, pa.binary()), pa.array(digests, pa.string())], [id, "n_paragraphs", "fingerprint", "digest"])

    return docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, f"`{id}` {kind}, n_paragraphs int, fingerprint binary, digest string")


def edited(stored: DataFrame, inserted: DataFrame | None = None, deleted: DataFrame | None = None, id: str = "doc_id", paragraph: str = "paragraph") -> DataFrame:
    """``fingerprints`` rows after paragraphs ``(id, paragraph)`` were inserted and deleted; the texts aren't read again.

    Changes are summed by id before they meet the fingerprints, and the sum of a hot id is taken in parts first.
    Several changes of one id all count; blank and null paragraphs and ids that ``stored`` lacks change nothing, nor do
    changes of rows with a null fingerprint. Deleting what a text lacks is not noticed, as for any such sum.
    """
    changes = None
    for rows, sign in ((inserted, 1), (deleted, -1)):
        if rows is not None:
            part = rows.select(F.col(f"`{id}`").alias("k"), F.col(f"`{paragraph}`").alias("p"), F.lit(sign).alias("sign"))
            changes = part if changes is None else changes.unionByName(part)
    if changes is None:
        return stored
    kind = changes.schema["k"].dataType.simpleString()

    def vectors(batches):
        for batch in batches:
            totals: dict = {}
            for k, p, sign in zip(*(c.to_pylist() for c in batch.columns)):
                for x in paragraphs(" ".join((p or "").split())):
                    old = totals.setdefault(k, [np.zeros(LANES, np.uint16), 0])
                    old[0] = old[0] + element(x) if sign > 0 else old[0] - element(x)
                    old[1] += sign
            yield pa.RecordBatch.from_arrays([pa.array(list(totals), batch.schema.field(0).type), pa.array([v[0].astype("<u2").tobytes() for v in totals.values()], pa.binary()), pa.array([v[1] for v in totals.values()], pa.int32())], ["k", "v", "n"])

    def added(left: pa.Table) -> pa.Table:
        total = sum((np.frombuffer(v, "<u2") for v in left.column("v").to_pylist()), np.zeros(LANES, np.uint16)).astype("<u2")
        return pa.table({"k": left.column("k").slice(0, 1), "part": pa.array([0], pa.int32()), "v": pa.array([total.tobytes()], pa.binary()), "n": pa.array([sum(left.column("n").to_pylist())], pa.int32())})

    summed = changes.mapInArrow(vectors, f"k {kind}, v binary, n int").select("k", F.pmod(F.xxhash64("v"), F.lit(64)).cast("int").alias("part"), "v", "n")
    for key in (["k", "part"], ["k"]):
        summed = summed.groupBy(*key).applyInArrow(added, f"k {kind}, part int, v binary, n int")

    @F.pandas_udf("fingerprint binary, digest string")
    def plus(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        out = [x if x is None or y is None else merge(x, y) for x, y in zip(a, b)]
        return pd.DataFrame({"fingerprint": out, "digest": [None if x is None else hashlib.sha256(x).hexdigest() for x in out]})

    joined = stored.join(summed.select("k", "v", "n"), stored[id] == F.col("k"), "left").withColumn("new", plus("fingerprint", "v"))
    return joined.select(F.col(f"`{id}`"), (F.col("n_paragraphs") + F.coalesce("n", F.lit(0))).alias("n_paragraphs"), "new.fingerprint", "new.digest")


def oracle() -> str:
    """DuckDB SQL of the query over ``documents``; the fingerprint in base64."""
    space = r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
    byte = "('0x' || substr(h, 4 * j + {}, 2))::INTEGER"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS rn, doc_id, text FROM documents),
    p AS (SELECT rn, trim(regexp_replace(unnest(string_split(text, chr(10))), '{space}', ' ', 'g')) AS p FROM d),
    h AS (SELECT rn, i, sha256(i || ':' || p) AS h FROM p CROSS JOIN range({LANES // 16}) r(i) WHERE p <> ''),
    l AS (SELECT rn, 16 * i + j AS lane, sum({byte.format(1)} + 256 * {byte.format(3)})::BIGINT % 65536 AS v FROM h CROSS JOIN range(16) s(j) GROUP BY ALL),
    f AS (SELECT rn, unhex(string_agg(printf('%02x%02x', v % 256, v // 256), '' ORDER BY lane)) AS f FROM l GROUP BY rn),
    n AS (SELECT rn, count(*) FILTER (p <> '') AS n FROM p GROUP BY rn),
    a AS (SELECT doc_id, n, CASE WHEN text IS NOT NULL THEN coalesce(f, unhex(repeat('00', {2 * LANES}))) END AS f FROM d LEFT JOIN f USING (rn) LEFT JOIN n USING (rn))
    SELECT doc_id, n::INTEGER AS n_paragraphs, base64(f) AS fingerprint, sha256(f) AS digest FROM a"""

"""Toxicity by non-negative positive-unlabelled learning over word and word-beginning features.

The optimiser sees a bounded, hash-ordered sample: confirmed toxic documents and documents without a toxic label, which
count as unlabelled. How frequent a feature is among unlabelled text is counted over all documents, and scoring sees
every word of every document.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, free_name, slices, stored

#: Bounds of the training sample, in documents.
POSITIVES, UNLABELLED = 4000, 12000
#: Standard errors by which a feature must be more frequent among confirmed documents, as it must be by ``RATIO``.
ERRORS, RATIO = 4.0, 2.0
THRESHOLD = 0.5
_WORD = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[int]:
    """Hashes of the lower-cased word and of its beginnings of 4 to 7 letters."""
    return [zlib.crc32(("=" + word).encode()), *(zlib.crc32(word[:k].encode()) for k in range(4, min(8, len(word) + 1)))]


def recurring(counts) -> set[int]:
    """Features of a document: each hash met, and marks for those met in two and in three different words."""
    return {f | mark for f, n in counts.items() for mark in (0, 1 << 32, 1 << 33)[: min(n, 3)]}


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def document_features(text: str | None) -> list[int]:
    return sorted(recurring(Counter(f for w in words_of(text or "") for f in features(w))))


def select_features(feature: np.ndarray, in_p: np.ndarray, in_all: np.ndarray, n_p: int, n_all: int, prior: float) -> np.ndarray:
    """Features far more frequent among the positives than among all documents less the share that ``prior`` explains.

    ``in_p`` and ``in_all`` count the documents of either kind that have a feature. It must deviate by ``ERRORS``
    standard errors and more than ``RATIO``-fold; all such features are kept, sorted.
    """
    n_p, n_all = max(1, n_p), max(1, n_all)
    rate_p = in_p / n_p
    rate_n = np.maximum((in_all / n_all - prior * rate_p) / (1 - prior), 0.5 / n_all)
    error = np.sqrt(rate_p / n_p + rate_n / n_all)
    return np.sort(feature[(rate_p - rate_n > ERRORS * error) & (rate_p > RATIO * rate_n)])


def train(known: np.ndarray, rows: list, positive: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, l2: float = 1e-4) -> tuple[np.ndarray, np.ndarray, float]:
    """``(features, weights, bias)`` of a logistic scorer, minimising the non-negative risk with Adam.

    Risk: ``prior * E_p[l(+)] + max(0, E_u[l(-)] - prior * E_p[l(-)])`` with the sigmoid loss; where the bracket is
    negative the step goes up along it instead, as published for the non-negative estimator. ``rows`` are the places
    in ``known`` of the features of each document.
    """
    is_p = np.asarray(positive) == 1
    n_p, n_u = int(is_p.sum()), int((~is_p).sum())
    if not n_p or not len(known):
        return known, np.zeros(len(known)), -20.0
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    column = np.concatenate([np.asarray(r, np.int64) for r in rows])
    w, b = np.full(len(known), 0.2), -1.0
    m, v = np.zeros(len(known) + 1), np.zeros(len(known) + 1)

    def mean_slope(of, n, slope):
        d = np.where(of, slope, 0.0)
        return np.append(np.bincount(column, d[row], len(known)), d.sum()) / max(1, n)

    for step in range(1, steps + 1):
        s = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[column], len(rows)) + b, -30, 30)))
        slope = s * (1 - s)  # of the sigmoid loss
        up, down = mean_slope(is_p, n_p, slope), mean_slope(~is_p, n_u, slope)
        minus = down - prior * up
        negative = s[~is_p].mean() - prior * s[is_p].mean() if n_u else 0.0
        g = -prior * up + minus if negative >= 0 else -minus
        g = g + np.append(l2 * w, 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return known, w, float(b)


def sample(docs: DataFrame, labels: DataFrame, id: str, text: str, positives: int, unlabelled: int) -> tuple[DataFrame, float]:
    """``(y, f)`` of the training sample, class and features, and the class prior: the labelled documents' toxic share."""
    share = labels.where("toxic is not null and doc_id is not null").agg(F.avg("toxic")).first()[0]
    key = docs.schema[id].dataType
    toxic = labels.where("toxic = 1 and doc_id is not null").select(F.col("doc_id").cast(key).alias("k")).distinct()
    ids = docs.select(F.col(f"`{id}`").alias("k")).where("k is not null").distinct()
    order = F.xxhash64("k", F.lit(8))
    chosen = ids.join(toxic, "k", "left_semi").orderBy(order, "k").limit(positives).select("k", F.lit(1).alias("y"))
    rest = ids.join(toxic, "k", "left_anti").orderBy(order, "k").limit(unlabelled).select("k", F.lit(0).alias("y"))
    picked = chosen.unionByName(rest).toPandas()
    spark = docs.sparkSession
    picked = spark.createDataFrame(picked, T.StructType([T.StructField("k", key), T.StructField("y", T.IntegerType())]))

    def run(batches):
        for batch in slices(batches):
            rows = [document_features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int64()))], ["y", "f"])

    # The sample's ids are bounded by the two parameters, so they are broadcast.
    prior = float(np.clip(share if share is not None else 0.1, 0.005, 0.9))
    texts = docs.select(F.col(f"`{id}`").alias("k"), F.col(f"`{text}`").alias("text")).join(F.broadcast(picked), "k").select("y", "text")
    return stored(texts.mapInArrow(run, "y int, f array<long>")), prior


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", prior: float | None = None, positives: int = POSITIVES, unlabelled: int = UNLABELLED):
    """The scorer; ``prior`` is the share of toxic documents, by default that of the labelled ones.

    Null ids, of documents and of labels, and null labels aren't used. Rows that repeat an id are all used, with the
    label of that id; an id that is labelled toxic and not toxic counts as toxic. Null and empty texts have no
    features. Without toxic documents, as of empty tables, the scorer calls nothing toxic.
    """
    bound_batches(docs.sparkSession)
    rows, estimated = sample(docs, labels.select("doc_id", "toxic"), id, text, positives, unlabelled)
    prior = estimated if prior is None else prior
    n_p = rows.where("y = 1").count()

    def tally(batches):
        f, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            f, at = np.unique(np.concatenate([f, batch.column(0).flatten().to_numpy()]), return_inverse=True)
            n = np.bincount(at, np.concatenate([n, np.ones(len(at) - len(n), np.int64)]), len(f)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(n)], ["f", "n"])

    # A feature of no more positives can't deviate by so many errors, whatever its share of all documents.
    of_p = rows.where("y = 1").select("f").mapInArrow(tally, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).where(F.col("n") > ERRORS**2).toPandas().sort_values("f")
    known, in_p = of_p.f.to_numpy(np.int64), of_p.n.to_numpy(np.float64)
    if len(known):
        in_all, n_all = document_frequencies(docs, known, text)
        known = select_features(known, in_p, in_all, n_p, n_all, prior)

    def places(batches):
        for batch in batches:
            flat, offsets = batch.column(1).flatten().to_numpy(), batch.column(1).offsets.to_numpy()
            offsets = offsets - offsets[0]
            at = np.minimum(np.searchsorted(known, flat), max(0, len(known) - 1))
            hit = known[at] == flat if len(known) else np.zeros(len(flat), bool)
            sums = np.concatenate([[0], np.cumsum(hit)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(sums[offsets], pa.int32()), pa.array(at[hit], pa.int32()))], ["y", "f"])

    found = rows.mapInArrow(places, "y int, f array<int>").toPandas()
    return train(known, list(found.f), found.y.to_numpy(), prior)


class Features:
    """Which of some known features texts have; words met before are remembered, up to a bound.

    A feature is a hash with a mark. ``hashes`` are the hashes known with any mark, in order.
    """

    def __init__(self, known, remember: int = 100_000):
        self.hashes = np.unique(np.asarray(known, np.int64) & 0xFFFFFFFF)
        self.place = {int(h): i for i, h in enumerate(self.hashes)}
        self.remember, self.words = remember, {}

    def places(self, known) -> np.ndarray:
        """For each hash and each mark the place of that feature in the sorted features ``known``, -1 where it isn't."""
        known = np.asarray(known, np.int64)
        want = self.hashes[:, None] + np.array([0, 1 << 32, 1 << 33])
        at = np.minimum(np.searchsorted(known, want), max(0, len(known) - 1))
        return np.where(known[at] == want, at, -1) if len(known) else np.full(want.shape, -1)

    def __call__(self, texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(text, hash, times)`` as places, for each known hash that a text meets in 1, 2, or 3 and more words."""
        words, hits, sizes = self.words, [], []
        for text in texts:
            before = len(hits)
            for w in words_of(text or ""):
                found = words.get(w)
                if found is None:
                    found = [i for i in map(self.place.get, features(w)) if i is not None]
                    if len(words) >= self.remember:
                        words.clear()
                    words[w] = found
                if found:
                    hits += found
            sizes.append(len(hits) - before)
        code = np.repeat(np.arange(len(sizes)), sizes) * max(1, len(self.hashes)) + np.asarray(hits, np.int64)
        code, times = np.unique(code, return_counts=True)
        return code // max(1, len(self.hashes)), code % max(1, len(self.hashes)), np.minimum(times, 3)


class Scorer:
    """Scores texts."""

    def __init__(self, model):
        known, weight = np.asarray(model[0], np.int64), np.asarray(model[1], np.float64)
        self.bias, self.features = model[2], Features(known)
        at = self.features.places(known)
        self.weight = np.cumsum(np.where(at >= 0, weight[at] if len(weight) else 0.0, 0.0), axis=1)

    def __call__(self, texts) -> np.ndarray:
        row, hash, times = self.features(texts)
        z = self.bias + np.bincount(row, self.weight[hash, times - 1], len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def document_frequencies(docs: DataFrame, known: np.ndarray, text: str = "text") -> tuple[np.ndarray, int]:
    """How many of all documents have each of the sorted features ``known``, and how many documents there are.

    The features are those of the positive sample, so they are few; each task counts them in one array.
    """
    held = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        known = held.value
        features = Features(known)
        at = features.places(known)
        counts, rows = np.zeros(len(known) + 1, np.int64), 0
        for batch in slices(batches):
            _, hash, times = features(batch.column(0).to_pylist())
            for k in range(3):
                counts += np.bincount(at[hash[times > k], k] + 1, minlength=len(counts))
            rows += len(batch)
        counts = counts[1:]
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(counts[some], rows))], ["i", "n"])

    seen = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toPandas()
    out, at = np.zeros(len(known)), seen.i.to_numpy(np.int64)
    out[at[at >= 0]] = seen.n.to_numpy(np.float64)[at >= 0]
    return out, int(seen.n.to_numpy()[at < 0].sum())


def score(docs: DataFrame, model, text: str = "text", out: str = "toxicity") -> DataFrame:
    """``docs`` with the probability-like score of each text in column ``out`` (renamed with underscores if taken).

    A null or empty text scores by the bias alone, which is below the threshold whenever toxic documents are rare.
    Equal texts get equal scores, every row stays, repeated ones too, and an empty table stays empty; texts of any
    length are read whole. Without any toxic label nothing is flagged.
    """
    bound_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(held.value)
        for texts in batches:
            yield pa.array(scorer(texts.to_pylist()), pa.float64())

    return docs.withColumn(free_name(docs, out), run(F.col(f"`{text}`")))

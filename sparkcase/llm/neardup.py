"""Near-duplicates by MinHash with tensored banding.

``SIDES`` small collections on the left and as many on the right hold ``HALF`` minhashes each; every pair of a left and
a right collection is the key of one table. ``2 * SIDES * HALF`` minhashes thus serve ``SIDES ** 2`` tables of
``2 * HALF`` hashes each. Equal word sequences are merged first. The first node of each table entry is a candidate with
every other; where that doesn't make one component of an entry, its nodes go through a prefix filter, which loses no
similar pair and makes no pair of texts that only share frequent passages. Candidates are verified by the exact Jaccard
similarity of their shingles, and groups are the connected components of the verified pairs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, fits, slices, stored, token_hashes

#: A pair of similarity ``s`` shares a table with probability ``(1 - (1 - s**HALF)**SIDES)**2``: 0.91 at 0.6, 0.98 at 0.7.
SIDES, HALF, SHINGLE, SIMILARITY = 7, 2, 3, 0.6
#: Frequent shingles that the prefix filter puts last (more would only make it sharper); nodes of one shingle in a run.
HEAVY, RUN = 500_000, 4096


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _shingled(tokens: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts one after another and where each text's begin (one more at the end).

    A text of fewer than ``width`` words has one shingle, all its words; one without words has none.
    """
    offsets = tokens.offsets.to_numpy().astype(np.int64)
    flat = tokens.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    offsets = offsets - offsets[0]
    size = np.diff(offsets)
    keep = np.where(size >= width, size - width + 1, np.minimum(size, 1))
    bounds = np.concatenate([[0], np.cumsum(keep)])
    at = np.arange(bounds[-1]) + np.repeat(offsets[:-1] - bounds[:-1], keep)
    limit = np.repeat(offsets[1:], keep)
    h = np.zeros(len(at), np.uint64)
    for k in range(width):
        inside = at + k < limit
        h = np.where(inside, h * np.uint64(0x9E3779B97F4A7C15) + flat[np.minimum(at + k, len(flat) - 1)] if len(flat) else h, h)
    return _spread(h), bounds


def signatures(docs: DataFrame, id: str, text: str, sides: int = SIDES, half: int = HALF, width: int = SHINGLE, seed: int = 1) -> DataFrame:
    """``(id, node, halves, th)``: the word sequence's hash, the ``2 * sides`` collections of minhashes, the text's hash.

    Texts without any word get the hash of the text and no halves, so only equal ones meet; null texts get no node.
    """
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 1 << 63, 2 * sides * half, np.uint64) | np.uint64(1)
    kind = docs.schema[id].dataType.simpleString()

    def run(batches):
        for batch in slices(batches):
            tokens, blank = batch.column(1), batch.column(2).to_pylist()
            lists = tokens.fill_null([])
            h, bounds = _shingled(lists, width)
            some = np.flatnonzero(np.diff(bounds))
            out = np.zeros((len(batch), 2 * sides), np.uint64)
            if len(some):
                for c in range(2 * sides):
                    key = np.zeros(len(some), np.uint64)
                    for r in range(half):
                        mins = np.minimum.reduceat((h * a[c * half + r]) >> np.uint64(16), bounds[some])
                        key = _spread(key * np.uint64(31) + mins)
                    out[some, c] = key
            offsets = lists.offsets.to_numpy()
            raw = lists.flatten().to_numpy(zero_copy_only=False).tobytes()
            base = offsets[0]
            nodes = [None if null else hashlib.md5(raw[8 * (o - base) : 8 * (p - base)] if p > o else b"=" + blank[i].encode()).digest() for i, (null, o, p) in enumerate(zip(tokens.is_null().to_pylist(), offsets[:-1], offsets[1:]))]
            has = np.zeros(len(batch), bool)
            has[some] = True
            halves = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * 2 * sides, pa.int32()), pa.array(out.view(np.int64).ravel()), mask=pa.array(~has))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.binary()), halves, batch.column(3)], ["id", "node", "halves", "th"])

    tokens = token_hashes(F.col(text))
    blank = F.when(~F.col(text).rlike(r"[\p{L}\p{N}]"), F.col(text))
    return docs.select(F.col(id), tokens.alias("tokens"), blank.alias("blank"), F.xxhash64(F.col(text)).alias("th")).mapInArrow(run, f"id {kind}, node binary, halves array<long>, th long")


def _shingle_sets(docs: DataFrame, need: DataFrame, id: str, text: str, width: int) -> DataFrame:
    """``(node, s)``: the distinct shingles of the needed ``(id, th, node)``, found by id, null or not, and the text's hash."""
    want = need.select(F.col("id").alias("want_id"), F.col("th").alias("want_th"), F.col("node").alias("want"))
    want = F.broadcast(want) if fits(want, 72) else want
    rows = docs.select(F.col(f"`{id}`").alias("k"), F.col(f"`{text}`").alias("text"), F.xxhash64(F.col(f"`{text}`")).alias("th"))
    found = rows.join(want, F.col("k").eqNullSafe(F.col("want_id")) & (F.col("th") == F.col("want_th"))).select("want", token_hashes(F.col("text")).alias("tokens"))

    def run(batches):
        for batch in slices(batches):
            lists = batch.column(1).fill_null([])
            h, bounds = _shingled(lists, width)
            offsets = lists.offsets.to_numpy()
            raw, base = lists.flatten().to_numpy(zero_copy_only=False).tobytes(), offsets[0]
            same = [i for i, w in enumerate(batch.column(0).to_pylist()) if w == hashlib.md5(raw[8 * (offsets[i] - base) : 8 * (offsets[i + 1] - base)]).digest()]
            sets = [np.unique(h[bounds[i] : bounds[i + 1]]).view(np.int64) for i in same]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(same, pa.int64())), pa.array(sets, pa.list_(pa.int64()))], ["node", "s"])

    return found.mapInArrow(run, "node binary, s array<long>").dropDuplicates(["node"])


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``(a, b)`` whose exact Jaccard similarity is ``similarity`` or more."""
    left = sets.select(F.col("node").alias("a"), F.col("s").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("s").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(right, "b").join(left, "a").where(both >= similarity * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of every node of the edges ``(a, b)``: the smallest node of its connected component.

    Alternates large-star and small-star steps, each written to the shared folder, until nothing changes.
    """
    edges = stored(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(down.select("u", F.col("m").alias("v")))
        edges = stored(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _heavy(sets: DataFrame, limit: int = HEAVY) -> np.ndarray:
    """The shingles that most nodes have, the most frequent last: at most ``limit``, of two nodes or more."""

    def run(batches):
        x, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in slices(batches):
            new, m = np.unique(batch.column(0).flatten().to_numpy(zero_copy_only=False), return_counts=True)
            x, at = np.unique(np.concatenate([x, new]), return_inverse=True)
            n = np.bincount(at, np.concatenate([n, m]), len(x)).astype(np.int64)
            if len(x) > 2_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(n)], ["x", "n"])
                x, n = x[:0], n[:0]
        yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(n)], ["x", "n"])

    counted = sets.select("s").mapInArrow(run, "x long, n long").groupBy("x").agg(F.sum("n").alias("n")).where("n > 1")
    return counted.orderBy(F.desc("n"), "x").limit(limit).select("x").toArrow().column("x").to_numpy()[::-1]


def _prefixes(sets: DataFrame, similarity: float, heavy: np.ndarray) -> DataFrame:
    """``(x, node, root, size, at)`` of ``(node, root, s)``: the shingles that a set must share one of with any set of
    the given similarity, and their places. All sets are in one order, in which frequent shingles come last."""
    order = np.argsort(heavy)
    known, place = heavy[order], order + 1
    held = sets.sparkSession.sparkContext.broadcast((known, place))

    def run(batches):
        known, place = held.value
        for batch in slices(batches):
            lists = batch.column(2)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
                late = np.where(known[at] == flat, place[at], 0)
            else:
                late = np.zeros(len(flat), np.int64)
            row = np.repeat(np.arange(len(size)), size)
            o = np.lexsort((flat, late, row))
            nth = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
            keep = nth < np.repeat(size - np.ceil(similarity * size - 1e-9).astype(np.int64) + 1, size)
            row, x, nth = row[keep], flat[o][keep], nth[keep]
            yield pa.RecordBatch.from_arrays([pa.array(x), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(size[row].astype(np.int32)), pa.array(nth.astype(np.int32))], ["x", "node", "root", "size", "at"])

    return sets.select("node", "root", "s").mapInArrow(run, "x long, node binary, root binary, size int, at int")


def _across(placed: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``(a, b)`` of nodes ``(node, root)`` of different roots that may be similar: by prefix filter, none is lost.

    Sets of that similarity share a shingle of their prefixes, with enough shingles behind it on both sides. Of the
    nodes with a shingle those outside its largest component meet all the others; a frequent shingle's nodes are cut
    into runs of ``RUN``, so no task holds all of them.
    """
    own = stored(placed.join(sets, "node").select("node", "root", "s"))
    entries = stored(_prefixes(own, similarity, _heavy(own)))
    of = entries.groupBy("x", "root").agg(F.count("*").alias("n")).groupBy("x").agg(F.max_by("root", F.struct("n", "root")).alias("most"), F.sum("n").alias("n"), F.count("*").alias("roots"))
    mixed = entries.join(of.where("roots > 1").select("x", "most", F.ceil(F.col("n") / RUN).cast("int").alias("runs")), "x")
    left = mixed.select("x", F.pmod(F.xxhash64("node"), F.col("runs")).cast("int").alias("run"), F.col("node").alias("a"), F.col("root").alias("ra"), F.col("size").alias("na"), F.col("at").alias("i"), (F.col("root") == F.col("most")).alias("inner"))
    right = mixed.where("root != most").select("x", F.explode(F.sequence(F.lit(0), F.col("runs") - 1)).alias("run"), F.col("node").alias("b"), F.col("root").alias("rb"), F.col("size").alias("nb"), F.col("at").alias("j"))
    both = left.join(right, ["x", "run"]).where("ra != rb and (inner or a < b)")
    need = F.lit(similarity / (1 + similarity)) * (F.col("na") + F.col("nb")) - 1e-9
    both = both.where((F.least("na", "nb") >= similarity * F.greatest("na", "nb") - 1e-9) & (F.least(F.col("na") - F.col("i"), F.col("nb") - F.col("j")) >= need))
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def nodes(docs: DataFrame, id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, sides: int = SIDES, half: int = HALF, width: int = SHINGLE) -> DataFrame:
    """``(id, th, root)`` of every row with a text: the text's hash and the root of its group."""
    bound_batches(docs.sparkSession)
    docs = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    sigs = stored(signatures(docs, "id", "text", sides, half, width).where("node is not null"))
    reps = sigs.groupBy("node").agg(F.first("halves").alias("halves")).where("halves is not null")
    keys = F.array(*(F.xxhash64(F.lit(i * sides + j), F.col("halves")[i], F.col("halves")[sides + j]) for i in range(sides) for j in range(sides)))
    rows = reps.select("node", F.explode(keys).alias("key"))
    # First the star of each table entry: its least node with every other.
    first = rows.groupBy("key").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1").select("key", "a")
    shared = stored(rows.join(first, "key").select("key", "a", F.col("node").alias("b")))
    stars = stored(shared.where("a != b").select("a", "b").distinct())
    least = F.min(F.struct(F.col("id").isNull(), "id", "th")).alias("least")
    need = sigs.join(shared.select(F.col("b").alias("node")).distinct(), "node", "left_semi").groupBy("node").agg(least).select("node", "least.id", "least.th")
    sets = stored(_shingle_sets(docs, stored(need), "id", "text", width))
    good = stored(_verified(stars, sets, similarity))
    # Then the nodes of entries that are not one component yet: no pairs of an entry, but those that a prefix filter
    # over all these nodes lets pass.
    found = components(good)
    placed = shared.select("key", F.col("b").alias("node")).join(found, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x != y").select("key")
    apart = stored(placed.join(mixed, "key").select("node", "root").distinct())
    more = _across(apart, sets, similarity).join(stars, ["a", "b"], "left_anti")
    better = stored(_verified(stored(more), sets, similarity))
    found = stored(components(good.unionByName(better)))
    return sigs.select("id", "node", "th").join(found, "node", "left").select("id", "th", F.coalesce("root", "node").alias("root"))


def groups(docs: DataFrame, id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``(id, group_id, group_size)`` of every row that has a duplicate; ``group_id`` is the least id of the group.

    Equal word sequences are one group; others join it if the Jaccard similarity of their shingles with one of its
    members reaches the threshold. Texts without words are duplicates only of equal texts, null texts of none.
    Repeated rows are duplicates of each other, also rows of one id; a null id is grouped but never names a group
    that has another id. Texts of any length are compared whole; an empty table gives no rows. ``how`` passes the
    parameters of ``nodes``. Other columns are dropped.
    """
    placed = stored(nodes(docs, id, text, **how))
    of = placed.groupBy("root").agg(F.min("id").alias("group_id"), F.count("*").alias("group_size")).where("group_size > 1")
    return placed.join(of, "root").select(F.col("id").alias(id), "group_id", "group_size")


def deduplicate(docs: DataFrame, id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row of each group, the one with the least id, and every row without a duplicate; columns as in ``docs``.

    Rows with a null text all stay. Of rows that repeat both id and word sequence one stays.
    """
    placed = nodes(docs, id, text, **how).groupBy("root", "id", "th").agg(F.count("*").alias("n"))
    placed = stored(placed.withColumn("rank", F.struct(F.col("id").isNull(), "id", "th")))
    first = placed.groupBy("root").agg(F.min("rank").alias("first"))
    judged = placed.join(first, "root").select("id", "th", "n", (F.col("rank") == F.col("first")).alias("stays"))
    gone = stored(judged.where("not stays").select(F.col("id").alias("gone_id"), F.col("th").alias("gone_th")))
    again = stored(judged.where("stays and n > 1").select(F.col("id").alias("gone_id"), F.col("th").alias("gone_th")))
    one = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    tagged = docs.select(one, F.col(f"`{id}`").alias("k"), F.xxhash64(F.col(f"`{text}`")).alias("t"), F.col(f"`{text}`").isNotNull().alias("has"))

    def matching(rows, pairs, how):
        pairs = F.broadcast(pairs) if fits(pairs, 40) else pairs
        return rows.join(pairs, F.col("k").eqNullSafe(F.col("gone_id")) & (F.col("t") == F.col("gone_th")) & F.col("has"), how)

    kept = matching(tagged, gone, "left_anti")
    if again.limit(1).count():
        once = matching(kept, again, "left_semi").dropDuplicates(["k", "t"])
        kept = matching(kept, again, "left_anti").unionByName(once)
    return kept.select("row.*")

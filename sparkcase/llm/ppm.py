"""Prediction by partial matching: code lengths from a byte-context trie counted over the whole corpus.

Escapes follow method C (Moffat): a context with ``n`` symbols, ``d`` of them distinct, escapes with ``d / (n + d)``;
symbols seen in a longer context are excluded from the shorter ones. Every document is coded by the counts of all the
others: its own counts are taken out of the trie before it is coded, copies of it in other rows stay in.

The trie is a table of nodes (a context with the symbols that follow it) and no task ever holds all of it. Documents
are cut into parts of about ``PART`` bytes, every part names the contexts that occur in it, and a join fetches those
nodes for it. Only the nodes of the contexts of no and of one byte, at most 65,792 pairs, go to every executor.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, slices, stored

#: Longest context in bytes; texts of a part, and of one step of the coder, in bytes.
ORDER, PART, STEP = 5, 32 << 20, 1 << 18
#: Contexts of at most this many bytes go to every executor.
SHARED = 1


def _bytes(texts: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, ``order`` zeros before each, and the places where each text begins (one more at the end)."""
    raw = texts.cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64, len(raw) + raw.offset + 1)[raw.offset :]
    n = len(raw)
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if n else np.zeros(0, np.uint8)
    size = np.diff(offsets)
    starts = offsets[:-1] - offsets[0] + order * (np.arange(n) + 1)
    out = np.zeros(len(data) + order * n, np.uint8)
    out[np.arange(len(data)) + np.repeat(order * (np.arange(n) + 1), size)] = data
    return out, np.append(starts, len(out) + order)


def _low(code: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` least bytes of each code."""
    return code & np.uint64((1 << 8 * size) - 1)


def _summed(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order with the sums of their counts."""
    o = np.argsort(code)
    code, n = code[o], n[o]
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, np.int64)
    return code[first], np.add.reduceat(n, first) if len(first) else n


def grams(texts: pa.Array, order: int, apart: bool = False, piece: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes of (context, symbol) and their counts; the symbol is the lowest byte of a code.

    With ``apart`` the place of the text stands above the ``order + 1`` bytes of the pair. Texts are passed over in
    pieces, so memory follows the distinct codes.
    """
    data, starts = _bytes(texts, order)
    begins, ends = starts[:-1], starts[1:] - order
    codes, counts, held = [], [], 0
    for low in range(0, len(data), piece):
        high = min(len(data), low + piece)
        back = max(0, low - order)
        part = data[back:high].astype(np.uint64)
        code = np.zeros(len(part), np.uint64)
        for k in range(order + 1):
            code[k:] |= part[: len(part) - k] << np.uint64(8 * k)
        code = code[low - back :]
        at = np.arange(low, high)
        of = np.searchsorted(begins, at, "right") - 1
        real = (of >= 0) & (at < ends[np.maximum(of, 0)])
        code = code[real]
        if apart:
            code |= of[real].astype(np.uint64) << np.uint64(8 * (order + 1))
        code, n = np.unique(code, return_counts=True)
        codes.append(code)
        counts.append(n.astype(np.int64))
        held += len(code)
        if held > 3_000_000:
            code, n = _summed(np.concatenate(codes), np.concatenate(counts))
            codes, counts, held = [code], [n], 0
    if not codes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return (codes[0], counts[0]) if len(codes) == 1 else _summed(np.concatenate(codes), np.concatenate(counts))


def _find(known: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each ``wanted`` code in the sorted codes ``known``, -1 where it isn't."""
    if not len(known):
        return np.full(len(wanted), -1, np.int64)
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return np.where(known[at] == wanted, at, -1)


class Level:
    """Nodes of the contexts of ``k`` bytes: sorted pairs (context, symbol) with their counts, and each context's range."""

    __slots__ = ("pairs", "n", "contexts", "first", "total", "distinct", "node", "shorter")

    def __init__(self, pairs: np.ndarray, n: np.ndarray):
        self.pairs, self.n = pairs, n
        self.contexts, first = np.unique(pairs >> np.uint64(8), return_index=True)
        self.first = np.append(first, len(pairs))
        self.total = np.add.reduceat(n, first) if len(first) else np.zeros(0, np.int64)
        self.distinct = np.diff(self.first)
        self.node = np.repeat(np.arange(len(first)), self.distinct)
        self.shorter = None


class Own:
    """The pairs of one level that some texts have themselves, as (text, context, symbol), with what the rest of the
    corpus leaves of each.

    ``at`` are the pairs' places in the trie's level, ``node`` the number of each pair's (text, context); ``total`` and
    ``distinct`` are counts and symbols of that context without the text.
    """

    __slots__ = ("key", "n", "at", "left", "node", "contexts", "place", "total", "distinct")

    def __init__(self, level: Level, key: np.ndarray, n: np.ndarray, at: np.ndarray):
        self.key, self.n, self.at = key, n, at
        self.left = level.n[at] - n
        context = key >> np.uint64(8)
        new = np.append(True, context[1:] != context[:-1])[: len(context)]
        first = np.flatnonzero(new)
        self.node, self.contexts, self.place = np.cumsum(new) - 1, context[first], level.node[at[first]]
        self.total = level.total[self.place] - (np.add.reduceat(n, first) if len(first) else n)
        self.distinct = level.distinct[self.place] - np.bincount(self.node[self.left == 0], minlength=len(first))

    def shorter(self, level: Level, below: Level, k: int, shift: np.uint64) -> tuple[Own, np.ndarray]:
        """The same pairs one byte shorter, contexts of ``k`` bytes, and the place there of each pair here."""
        code = (self.key >> (shift + np.uint64(8)) << shift) | _low(self.key, k + 1)
        o = np.argsort(code)
        code = code[o]
        new = np.append(True, code[1:] != code[:-1])[: len(code)]
        first = np.flatnonzero(new)
        to = np.empty(len(o), np.int64)
        to[o] = np.cumsum(new) - 1
        n = np.add.reduceat(self.n[o], first) if len(first) else self.n
        return Own(below, code[first], n, level.shorter[self.at[o[first]]]), to


class Trie:
    """Levels of the contexts of 0 to ``order`` bytes: whole nodes of all contexts of the texts to be coded."""

    def __init__(self, levels: list[Level]):
        self.levels, self.order = levels, len(levels) - 1
        for k in range(1, len(levels)):
            levels[k].shorter = _find(levels[k - 1].pairs, _low(levels[k].pairs, k))

    @classmethod
    def of(cls, code: np.ndarray, n: np.ndarray, order: int) -> Trie:
        """The trie of counted codes of ``order + 1`` bytes."""
        return cls([Level(*_summed(_low(code, k + 1), n)) for k in range(order + 1)])

    def bits(self, texts: pa.Array) -> np.ndarray:
        """Code length of each text by the trie less the text's own counts; the texts must be among those counted."""
        key, times = grams(texts, self.order, apart=True)
        want, back = np.unique(_low(key, self.order + 1), return_inverse=True)
        at = _find(self.levels[-1].pairs, want)
        if len(at) and at.min() < 0:
            raise ValueError("a text was not counted")
        own, longer = Own(self.levels[-1], key, times, at[back]), None
        cost, todo, pair = np.zeros(len(key)), np.arange(len(key)), np.arange(len(key))
        for k in range(self.order, -1, -1):
            if longer is not None:
                own, to = longer.shorter(self.levels[k + 1], self.levels[k], k, np.uint64(8 * (k + 1)))
                above, pair = longer.node[pair], to[pair]
            node = own.node[pair]
            size, kinds = own.total[node], own.distinct[node]
            if longer is not None:
                gone = longer.distinct[above]
                live = np.flatnonzero(gone > 0)
                which, back = np.unique(above[live], return_inverse=True)
                size[live] -= self._excluded(k, longer, own, which)[back]
                kinds = kinds - gone
            whole = np.log2(np.maximum(size + kinds, 1))
            left = own.left[pair]
            hit = left > 0
            cost[todo[hit]] += whole[hit] - np.log2(left[hit])
            miss = ~hit
            cost[todo[miss]] += np.where(kinds[miss] > 0, whole[miss] - np.log2(np.maximum(kinds[miss], 1)), 0.0)
            todo, pair, longer = todo[miss], pair[miss], own
        # All symbols of the shortest context are excluded by now; the rest are equally likely.
        cost[todo] += np.log2(np.maximum(256 - longer.distinct[longer.node[pair]], 1))
        return np.bincount((key >> np.uint64(8 * (self.order + 1))).astype(np.int64), cost * times, len(texts))

    def _excluded(self, k: int, longer: Own, own: Own, which: np.ndarray) -> np.ndarray:
        """Of each (text, context of ``k + 1`` bytes): the counts that the symbols seen there have one byte shorter."""
        level, below = self.levels[k + 1], self.levels[k]
        place = longer.place[which]
        size = level.distinct[place]
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(level.first[place] - ends + size, size)
        text = np.repeat(longer.contexts[which] >> np.uint64(8 * (k + 1)), size)
        mine = _find(longer.key, (text << np.uint64(8 * (k + 2))) | level.pairs[at])
        seen = level.n[at] - np.where(mine >= 0, longer.n[mine], 0) > 0
        at, text = at[seen], text[seen]
        short = level.shorter[at]
        mine = _find(own.key, (text << np.uint64(8 * (k + 1))) | below.pairs[short])
        rest = below.n[short] - np.where(mine >= 0, own.n[mine], 0)
        return np.bincount(np.repeat(np.arange(len(place)), size)[seen], rest, len(place)).astype(np.int64)


def _checked(order: int) -> int:
    if not SHARED < order <= 5:
        raise ValueError(f"order must be between {SHARED + 1} and 5: a code holds order + 1 bytes and the place of a text")
    return order


def _parts(docs: DataFrame, kind: str, part: int) -> DataFrame:
    """``(id, text, part)`` of ``(id, text)``: neighbouring rows, about ``part`` bytes of text each, stored."""

    def run(batches):
        from pyspark import TaskContext

        number, held = TaskContext.get().partitionId() << 32, 0
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(batch), number), pa.int64())], ["id", "text", "part"])
            held += batch.column(1).nbytes
            if held >= part:
                number, held = number + 1, 0

    return stored(docs.mapInArrow(run, f"id {kind}, text string, part long"))


def counts(parts: DataFrame, order: int) -> DataFrame:
    """``(part, k, code, n)`` of ``(part, text)``: for ``k`` 0 how often each pair of ``order + 1`` bytes occurs in the
    part, for other ``k`` the contexts of ``k`` bytes that the part needs."""

    def run(batches):
        held: dict[int, list] = {}

        def rows(part):
            code, n = _summed(*(np.concatenate(x) for x in zip(*held.pop(part))))
            kinds = [(0, code, n)]
            for k in range(SHARED + 1, order + 1):
                context = np.unique(_low(code >> np.uint64(8), k))
                kinds.append((k, context, np.zeros(len(context), np.int64)))
            for k, code, n in kinds:
                for at in range(0, len(code), 1 << 18):
                    c = code[at : at + (1 << 18)].astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), part)), pa.array(np.full(len(c), k, np.int8)), pa.array(c), pa.array(n[at : at + len(c)])], ["part", "k", "code", "n"])

        for batch in slices(batches):
            of = batch.column(0).to_numpy()
            for part in np.unique(of):
                for other in [p for p in held if p != part]:
                    yield from rows(other)
                kept = held.setdefault(int(part), [])
                kept.append(grams(batch.column(1).filter(pa.array(of == part)), order))
                if sum(len(x) for x, _ in kept) > 3_000_000:
                    held[int(part)] = [_summed(*(np.concatenate(x) for x in zip(*kept)))]
        for part in list(held):
            yield from rows(part)

    return parts.mapInArrow(run, "part long, k byte, code long, n long")


def nodes(counted: DataFrame, order: int) -> DataFrame:
    """``(k, context, symbols, counts)``: the trie of all parts; a node has 256 symbols at most."""
    pairs = counted.where("k = 0").groupBy("code").agg(F.sum("n").alias("n"))
    levels = F.explode(F.array(*(F.struct(F.lit(k).cast("byte").alias("k"), F.col("code").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1)).alias("code")) for k in range(order + 1))))
    pairs = pairs.select(levels.alias("x"), "n").groupBy("x.k", "x.code").agg(F.sum("n").alias("n"))
    found = pairs.groupBy("k", F.shiftright("code", 8).alias("context")).agg(F.collect_list(F.struct(F.col("code").bitwiseAND(F.lit(255)).cast("short").alias("s"), "n")).alias("x"))
    return found.select("k", "context", F.col("x.s").alias("symbols"), F.col("x.n").alias("counts"))


def _pairs_of(t: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted pairs and counts of the nodes of level ``k`` in a table of nodes; a node given twice counts once."""
    t = t.filter(pa.compute.equal(t.column("k"), k)).combine_chunks()
    if not t.num_rows:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    symbols, n = (t.column(c).chunk(0) for c in ("symbols", "counts"))
    size = symbols.value_lengths().to_numpy(zero_copy_only=False)
    context = np.repeat(t.column("context").to_numpy().astype(np.uint64), size)
    pairs, first = np.unique(context << np.uint64(8) | symbols.flatten().to_numpy().astype(np.uint64), return_index=True)
    return pairs, n.flatten().to_numpy()[first]


def score(docs: DataFrame, id: str = "doc_id", text: str = "text", order: int = ORDER, part: int = PART) -> DataFrame:
    """``(id, n_bytes, bits, bits_per_byte)`` of every row of ``docs``.

    A row is coded by the counts of all other rows, so equal texts get equal bits and a text that others repeat gets
    few. A null text gives nulls; an empty text 0 bits and a null rate; a text of any length is coded whole. A table
    of one row has nothing to learn from: 8 bits a byte. Of an empty table nothing comes. Other columns are dropped.
    ``order`` is the longest context, the same at every size.
    """
    spark, order = docs.sparkSession, _checked(order)
    bound_batches(spark)
    kind = docs.schema[id].dataType.simpleString()
    rows = _parts(docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text")), kind, part)
    counted = stored(counts(rows.where("text is not null").select("part", "text"), order))
    trie = stored(nodes(counted, order))
    low = trie.where(F.col("k") <= SHARED).toArrow()  # 256 + 65,536 pairs at most
    shared = spark.sparkContext.broadcast([_pairs_of(low, k) for k in range(SHARED + 1)])
    needed = counted.where("k > 0").select("k", F.col("code").alias("context"), F.col("part").alias("of"))
    fetched = needed.join(trie, ["k", "context"]).select("of", "k", "context", "symbols", "counts")

    def code(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.combine_chunks()
        texts = left.column("text").chunk(0) if left.num_rows else pa.array([], pa.string())
        trie = Trie([Level(*x) for x in shared.value] + [Level(*_pairs_of(right, k)) for k in range(SHARED + 1, order + 1)])
        bits, size = np.zeros(len(texts)), pa.compute.binary_length(texts).fill_null(0).to_numpy().astype(np.int64)
        filled, ends, begin = texts.fill_null(""), np.cumsum(size), 0
        while begin < len(texts):
            end = max(begin + 1, min(begin + 60_000, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + STEP, "right"))))
            bits[begin:end] = trie.bits(filled.slice(begin, end - begin))
            begin = end
        pa.default_memory_pool().release_unused()
        gone = texts.is_null().to_numpy(zero_copy_only=False)
        rate = np.divide(bits, size, out=np.zeros(len(bits)), where=size > 0)
        return pa.table({id: left.column("id"), "n_bytes": pa.array(size, mask=gone), "bits": pa.array(bits, mask=gone), "bits_per_byte": pa.array(rate, mask=gone | (size == 0))})

    return rows.groupBy("part").cogroup(fetched.groupBy("of")).applyInArrow(code, f"`{id}` {kind}, n_bytes long, bits double, bits_per_byte double")


def score_adaptive(docs: DataFrame, id: str = "doc_id", text: str = "text", order: int = 3) -> DataFrame:
    """``(id, n_bytes, bits, bits_per_byte)`` by the adaptive coder: each document alone, from an empty trie.

    No row meets another, so nothing is shuffled. Nulls and empty texts as in ``score``; a trie takes memory in
    proportion to its text.
    """
    bound_batches(docs.sparkSession)
    kind = docs.schema[id].dataType.simpleString()

    def run(batches):
        for batch in slices(batches):
            raw = [None if t is None else t.encode() for t in batch.column(1).to_pylist()]
            bits = [None if b is None else Adaptive(order).code(b) for b in raw]
            rate = [x / len(b) if b else None for x, b in zip(bits, raw)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if b is None else len(b) for b in raw], pa.int64()), pa.array(bits, pa.float64()), pa.array(rate, pa.float64())], [id, "n_bytes", "bits", "bits_per_byte"])

    return docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, f"`{id}` {kind}, n_bytes long, bits double, bits_per_byte double")


class Adaptive:
    """Adaptive coder for one stream: the trie grows with every byte it codes, with update exclusion left out."""

    def __init__(self, order: int = ORDER):
        self.order, self.trie = order, {}

    def code(self, data: bytes) -> float:
        bits, history = 0.0, bytes(self.order) + data
        for i, symbol in enumerate(data):
            contexts = [history[i + self.order - k : i + self.order] for k in range(self.order, -1, -1)]
            excluded: set[int] = set()
            for context in contexts:
                seen = {s: c for s, c in self.trie.get((len(context), context), {}).items() if s not in excluded}
                if not seen:
                    continue
                total, distinct = sum(seen.values()), len(seen)
                if symbol in seen:
                    bits -= np.log2(seen[symbol] / (total + distinct))
                    break
                bits -= np.log2(distinct / (total + distinct))
                excluded |= set(seen)
            else:
                bits += np.log2(256 - len(excluded))
            for context in contexts:
                node = self.trie.setdefault((len(context), context), {})
                node[symbol] = node.get(symbol, 0) + 1
        return float(bits)

    def copy(self) -> Adaptive:
        other = Adaptive(self.order)
        other.trie = {k: dict(v) for k, v in self.trie.items()}
        return other

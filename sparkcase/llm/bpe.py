"""Byte-pair encoding and decoding over a table of distinct words.

Words are split by the JVM and named by their 64-bit hash; the table of distinct words is encoded once, each word
once, and the ids are joined back by position. A table under a checked size is joined by hash probing in every
task; a larger one is cut by document part, so that each task joins its part with the words of that part alone.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_LIMIT, bound_batches, free_name, slices, stored

#: The published split pattern of the rank files; ``(?U)`` gives ``\s`` its Unicode meaning.
PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NAME = "byte_bpe_50k.tiktoken"


def vocabulary(path: str | None = None) -> dict[bytes, int]:
    """Ranks of a vocabulary file: byte piece -> id. Without a path, the installed public file ``NAME``."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(NAME)
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _encoder(ranks):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN[4:], mergeable_ranks=ranks, special_tokens={})


def split_words(text):
    """The words of a text column as an array; joined together they are the text."""
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def _hashes(text, seed):
    return F.transform(split_words(text), lambda w: F.xxhash64(w, F.lit(seed)))


def word_table(docs: DataFrame, ranks: dict[bytes, int], text: str = "text", seed: int = 0) -> tuple[DataFrame, int]:
    """``(h, ids)``: every distinct word of ``docs``, encoded once, and the seed under which no two share a hash."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(ranks)

    def encode(batches):
        encoder = _encoder(held.value)
        for batch in batches:
            ids = [encoder._encode_single_piece(w.encode()) for w in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["h", "ids"])

    words = docs.select(F.explode(split_words(F.col(text))).alias("w")).distinct()
    while True:
        out = stored(words.select(F.xxhash64("w", F.lit(seed)).alias("h"), "w").mapInArrow(encode, "h long, ids array<int>"))
        if out.count() == out.agg(F.count_distinct("h")).first()[0]:
            return out, seed
        seed += 1


class _Index:
    """Maps word hashes to ids by bucketed probing; holds about 18 bytes a word and 2 or 4 an id."""

    def __init__(self, chunks):
        """``chunks``: pairs of Arrow columns (hashes, lists of ids), each chunk above the last in unsigned order."""
        done = [self._chunk(h, ids) for h, ids in chunks]
        self.h, self.size, self.ids = (np.concatenate([c[k] for c in done]) for k in range(3))
        del done
        self.start = (np.cumsum(self.size, dtype=np.uint32) - self.size).astype(np.uint32)
        self.bits = np.uint64(64 - max(1, int(len(self.h)).bit_length()))
        self.first = np.searchsorted(self.h, np.arange(1 << int(64 - self.bits), dtype=np.uint64) << self.bits).astype(np.uint32)

    @staticmethod
    def _chunk(h, ids):
        h, ids = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (h, ids))
        words = h.to_numpy().view(np.uint64)
        order = np.argsort(words)
        size = ids.value_lengths().to_numpy(zero_copy_only=False)
        size = size.astype(np.uint16 if not len(size) or size.max() < 1 << 16 else np.uint32)
        ids = ids.take(pa.array(order)).flatten().to_numpy(zero_copy_only=False)
        return words[order], size[order], ids.astype(np.uint16) if not len(ids) or ids.max() < 1 << 16 else ids

    def __call__(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the words ``h``, all of them known, and the number of ids of each."""
        h = h.view(np.uint64)
        at = self.first[h >> self.bits]
        todo = np.flatnonzero(self.h[at] != h)
        while len(todo):
            at[todo] += 1
            todo = todo[self.h[at[todo]] != h[todo]]
        size = self.size[at].astype(np.int64)
        ends = np.cumsum(size)
        flat = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[at] - ends + size, size)
        return self.ids[flat], size


def _lists(of: pa.Array, flat: np.ndarray, size: np.ndarray) -> pa.Array:
    """Ids of each row of ``of`` (lists of word hashes), null where the row is null."""
    bounds = np.concatenate([[0], np.cumsum(size)])
    offsets = of.offsets.to_numpy()
    return pa.ListArray.from_arrays(pa.array(bounds[offsets - offsets[0]], pa.int32()), pa.array(flat, pa.int32()), mask=of.is_null())


def _decoded(ids: pa.Array, pieces: pa.Array) -> pa.Array:
    """Texts of lists of ids, by an index join with the pieces: the joined bytes of a list lie side by side."""
    joined = pieces.take(ids.flatten())
    ends = np.frombuffer(joined.buffers()[1], np.int32, len(joined) + 1 + joined.offset)[joined.offset:] if len(joined) else np.zeros(1, np.int32)
    offsets = ids.offsets.to_numpy()
    bounds = pa.array(ends[offsets - offsets[0]], pa.int32())
    data = joined.buffers()[2] if len(joined) else pa.py_buffer(b"")
    valid = pa.array([not x for x in ids.is_null().to_pylist()])
    return pa.Array.from_buffers(pa.binary(), len(ids), [valid.buffers()[1], bounds.buffers()[1], data])


def piece_array(ranks: dict[bytes, int]) -> pa.Array:
    pieces: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for piece, i in ranks.items():
        pieces[i] = piece
    return pa.array(pieces, pa.binary())


def encode(docs: DataFrame, ranks: dict[bytes, int] | None = None, id: str = "doc_id", text: str = "text", limit: int = BROADCAST_LIMIT * 2, part_bytes: int = 16 << 20, ids: bool = True) -> DataFrame:
    """``(id, token_ids, n_tokens)`` of every row of ``docs``; without ``ids`` only the counts.

    A null text gives null ids and count, an empty text an empty list and 0; a text of any length is encoded whole, an
    empty table gives none. Every row gives a row, repeated ids and rows too; other columns are dropped, whatever their
    names. ``limit`` bounds the bytes of the word table that every executor gets; beyond it
    documents and words are joined part by part, ``part_bytes`` characters a part.
    """
    ranks = ranks or vocabulary()
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    words, seed = word_table(docs, ranks)
    n, pieces = words.agg(F.count("*"), F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()
    fields = [T.StructField(id, docs.schema["id"].dataType), T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.IntegerType())]
    schema = T.StructType(fields if ids else fields[::2])

    def result(key, lists, index):
        flat, size = index(lists.flatten().to_numpy(zero_copy_only=False)) if len(lists.flatten()) else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        out = _lists(lists, flat, size)
        return [key, out, out.value_lengths()] if ids else [key, out.value_lengths()]

    if 20 * n + 4 * pieces <= limit:
        def fetched():  # in slices of the hash range, so that the driver never holds the table twice
            for k in range(16):
                t = words.where(F.shiftrightunsigned("h", 60) == k).select("h", "ids").toArrow()
                yield t.column("h"), t.column("ids")

        held = spark.sparkContext.broadcast(_Index(fetched()))

        def join(batches):
            for batch in slices(batches):
                yield pa.RecordBatch.from_arrays(result(batch.column(0), batch.column(1), held.value), schema.names)

        return docs.select("id", _hashes(F.col("text"), seed).alias("h")).mapInArrow(join, schema)

    # Parts of about ``part_bytes`` characters, whatever repeats; stored, as the parts are drawn at random.
    parts = max(1, (docs.agg(F.sum(F.length("text"))).first()[0] or 0) // part_bytes)
    drawn = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts)).alias("part")
    tagged = stored(docs.select(drawn, "id", _hashes(F.col("text"), seed).alias("hs")))
    schema = T.StructType([T.StructField(id, tagged.schema["id"].dataType), *schema.fields[1:]])  # a written table's nested fields may be null
    used = tagged.select("part", F.explode("hs").alias("h")).distinct().join(words, "h").select(F.col("part").alias("of"), "h", "ids")

    def join_part(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            kinds = [left.schema.field("id").type, pa.list_(pa.int32()), pa.int32()]
            return pa.table([pa.array([], k) for k in (kinds if ids else kinds[::2])], schema.names)
        index = _Index([(right.column("h"), right.column("ids"))]) if right.num_rows else None
        return pa.table(result(left.column("id").combine_chunks(), left.column("hs").combine_chunks(), index), schema.names)

    return tagged.groupBy("part").cogroup(used.groupBy("of")).applyInArrow(join_part, schema)


def counted(docs: DataFrame, out: str, ranks: dict[bytes, int] | None = None, text: str = "text") -> DataFrame:
    """``docs`` with the number of tokens of each text in a new column ``out``; null where the text is."""
    row = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)))
    sizes = encode(docs.select(row.alias("row"), F.col(f"`{text}`").alias("text")), ranks, "row", ids=False)
    return sizes.select(*(F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(docs.columns)), F.col("n_tokens").alias(out))


def decode(encoded: DataFrame, ranks: dict[bytes, int] | None = None, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids in column ``out``, by a join of each id with its piece.

    The pieces are a table of fixed size, indexed by id, that every task holds. Null ids give a null text, an empty
    list an empty one. A column already named ``out`` is kept: the new one then gets underscores behind its name.
    Ids outside the vocabulary raise an error, a null among the ids of a list stands for no piece; bytes that are not
    UTF-8 stay as they are. Every row stays, of an empty table none.
    """
    pieces = encoded.sparkSession.sparkContext.broadcast(piece_array(ranks or vocabulary()).to_pylist())
    out = free_name(encoded, out)
    at = encoded.columns.index(ids)

    def join(batches):
        known = pa.array(pieces.value, pa.binary())
        for batch in slices(batches):
            texts = _decoded(batch.column(at), known)
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*batch.schema.names, "raw"])

    names = [f"c{i}" for i in range(len(encoded.columns))]  # a name with a dot can't be handed to Python
    kinds = [T.StructField(n, f.dataType) for n, f in zip(names, encoded.schema.fields)]
    found = encoded.toDF(*names).mapInArrow(join, T.StructType([*kinds, T.StructField("raw", T.BinaryType())]))
    return found.select(*(F.col(n).alias(c) for n, c in zip(names, encoded.columns)), F.col("raw").cast("string").alias(out))

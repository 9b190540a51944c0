"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact length in tokens of operator 1's vocabulary. Each source gets its share of the token budget: first the same fraction
of every length, then a bounded-knapsack over the remaining documents of each length fills what is left of the share.
Which documents of a length are taken is decided by a seeded hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .common import fits, free_name, stored

#: Production mix: weights by source; sources not named share ``OTHER`` by their size.
WEIGHTS = {"src0": 0.2, "src1": 0.08, "src2": 0.08}
OTHER, BUDGET, SEED = 0.64, 0.7, 17


def budgets(totals: dict, weights: dict = WEIGHTS, other: float = OTHER, budget: float = BUDGET) -> dict:
    """Tokens of each source: its weight of ``budget`` times all tokens, never more than it has.

    What a source cannot give is offered to the others in proportion to their shares, until all is placed or used up.
    """
    rest = sum(t for s, t in totals.items() if s not in weights)
    share = {s: weights[s] if s in weights else other * t / rest for s, t in totals.items() if s in weights or rest}
    left, out = int(budget * sum(totals.values())), dict.fromkeys(totals, 0)
    open_ = [s for s in sorted(totals, key=str) if share.get(s, 0) > 0]
    while open_ and left > 0:
        whole = sum(share[s] for s in open_)
        full = [s for s in open_ if left * share[s] / whole >= totals[s]]
        if not full:
            for s in open_:
                out[s] = int(left * share[s] / whole)
            break
        for s in full:
            out[s] = totals[s]
        left -= sum(totals[s] for s in full)
        open_ = [s for s in open_ if s not in full]
    return out


def choose(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length (ascending, distinct, positive) to take for ``budget`` tokens.

    The fraction ``budget / total`` of each count is taken; then, longest first, single documents while more than two
    of the longest are missing. What is left is filled by bounded-knapsack dynamic programming: as close from below
    as any choice of the documents still free.
    """
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    taken = (counts * (budget / total)).astype(np.int64)
    left = budget - int((lengths * taken).sum())
    spare = counts - taken
    for i in np.argsort(-lengths, kind="stable"):
        slack = 2 * int(lengths[spare > 0].max(initial=0))
        if left <= slack:
            break
        n = int(min(spare[i], (left - slack) // lengths[i] + 1, left // lengths[i]))
        taken[i], spare[i], left = taken[i] + n, spare[i] - n, left - n * int(lengths[i])
    # Bit k of ``reached`` says that a sum of k is possible; parts of 1, 2, 4, ... documents bound each length.
    reached, mask, steps = 1, (1 << (left + 1)) - 1, []
    goal = 1 << left
    for i in np.flatnonzero(spare):
        n, part = int(min(spare[i], left // lengths[i])), 1
        while n > 0:
            part = min(part, n)
            steps.append((i, part, reached))
            reached |= (reached << part * int(lengths[i])) & mask
            n, part = n - part, part * 2
        if reached & goal:
            break
    at = reached.bit_length() - 1
    for i, part, before in reversed(steps):
        if not before >> at & 1:
            taken[i] += part
            at -= part * int(lengths[i])
    return taken


def _plan(counted: DataFrame, weights: dict, other: float, budget: float) -> DataFrame:
    """``counted`` with ``take``. The driver sees the named sources' totals and one of all others, which share in
    proportion to their size; each source is planned by itself, from its table of lengths."""
    named = F.when(F.col("source").isin(*weights), F.col("source")) if weights else F.lit(None).cast("string")
    totals = {r["who"]: int(r["t"]) for r in counted.groupBy(named.alias("who")).agg(F.sum(F.col("len") * F.col("n")).alias("t")).collect()}
    shares, rest = budgets(totals, weights, other, budget), totals.get(None, 0)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("len", ignore_index=True)
        some = pdf.len.to_numpy() > 0
        take, lengths, n = pdf.n.to_numpy().copy(), pdf.len.to_numpy()[some], pdf.n.to_numpy()[some]
        who, own = pdf.source.iloc[0], int((lengths * n).sum())
        share = shares[who] if not pd.isna(who) and who in weights else shares.get(None, 0) * own // max(rest, 1)
        take[some] = choose(lengths, n, share)
        return pdf.assign(take=take)

    return counted.groupBy("source").applyInPandas(fit, f"source {counted.schema['source'].dataType.simpleString()}, len long, n long, take long")


def _counted(docs: DataFrame, text: str, ranks: dict | None, name: str) -> DataFrame:
    rows = bpe.counted(docs, name, ranks, text)
    return rows.withColumn(name, F.coalesce(F.col(name), F.lit(0)).cast("long"))


def plan(docs: DataFrame, source: str = "source", text: str = "text", weights: dict = WEIGHTS, other: float = OTHER, budget: float = BUDGET, ranks: dict | None = None) -> DataFrame:
    """``(source, len, n, take)``: documents of each length in each source and how many of them the mix takes.

    Documents without tokens cost nothing and are all kept. A null source is a source of its own, by size.
    """
    rows = _counted(docs.select(F.col(f"`{source}`").alias("source"), F.col(f"`{text}`").alias("text")), "text", ranks, "len")
    return _plan(stored(rows.groupBy("source", "len").agg(F.count("*").alias("n"))), weights, other, budget)


def mix(docs: DataFrame, id: str = "doc_id", source: str = "source", text: str = "text", seed: int = SEED, weights: dict = WEIGHTS, other: float = OTHER, budget: float = BUDGET, ranks: dict | None = None, tokens: str | None = None) -> DataFrame:
    """The chosen rows of ``docs`` with their columns, and their lengths in a new column ``tokens`` if it is named.

    Of each length in each source the documents with the lowest seeded hash of id and text are taken, equal hashes by
    id; rows that repeat both are told apart by nothing, so as many copies stay as the plan asks for. A null or empty
    text has no tokens, a text of any length is counted whole. An empty table stays empty.
    """
    columns = docs.columns
    words, hash = free_name(docs, tokens or "n_tokens"), free_name(docs, "h")
    key = F.xxhash64(F.lit(seed), F.col(f"`{id}`"), F.col(f"`{text}`"))
    docs = stored(_counted(docs, text, ranks, words).withColumn(hash, key))
    order_key = F.struct(F.col(hash).alias("h"), F.col(f"`{id}`").alias("id")).alias("o")
    keyed = docs.select(F.col(f"`{source}`").alias("source"), F.col(words).alias("len"), order_key)
    planned = stored(_plan(stored(keyed.groupBy("source", "len").agg(F.count("*").alias("n"))), weights, other, budget))
    # The last order key that still fits each length, instead of a rank for each row: the texts are not shuffled.
    cut = planned.where("take > 0 and take < n").select(F.col("source").alias("of"), F.col("len").alias("of_len"), "take")
    cut = F.broadcast(cut) if fits(cut, 64) else cut
    order = Window.partitionBy("of", "of_len").orderBy("o")
    ranked = keyed.join(cut, keyed["source"].eqNullSafe(cut["of"]) & (keyed["len"] == cut["of_len"])).select("of", "of_len", "take", "o", F.row_number().over(order).alias("nth"), F.rank().over(order).alias("first"), F.lead("o").over(order).alias("next"))
    last = ranked.where("nth = take").select("of", "of_len", F.col("o").alias("last"), F.col("next").eqNullSafe(F.col("o")).alias("split"), (F.col("take") - F.col("first") + 1).alias("copies"))
    whole = planned.where("take = n").select(F.col("source").alias("of"), F.col("len").alias("of_len"), F.lit(None).cast(last.schema["last"].dataType).alias("last"), F.lit(False).alias("split"), F.lit(0).cast("long").alias("copies"))
    limits = stored(last.unionByName(whole))
    one = F.struct(*(F.col(f"`{c}`") for c in columns + [words] * bool(tokens))).alias("row")
    tagged = docs.select(one, F.col(f"`{source}`").alias("source"), F.col(words).alias("len"), order_key)
    joined = tagged.join(F.broadcast(limits) if fits(limits, 96) else limits, F.col("source").eqNullSafe(F.col("of")) & (F.col("len") == F.col("of_len")))
    out = joined.where("last is null or o < last or (o = last and not split)").select("row.*")
    if limits.where("split").limit(1).count():
        copies = joined.where("o = last and split").withColumn("nth", F.row_number().over(Window.partitionBy("of", "of_len").orderBy("o")))
        out = out.unionByName(copies.where("nth <= copies").select("row.*"))
    return out

"""The corpus pipeline: five of the training-data operators, one after another over all documents.

Texts of any length are read whole. An empty table gives an empty table at every stage; extra columns pass through all
stages but the last, whatever their names.
"""

from __future__ import annotations

from sparkcase.llm import bpe, mixing, neardup, quality, toxicity
from sparkcase.llm.common import stored, table


def quality_rules(spark, docs, sf_dir):
    """Keeps the documents whose posterior quality reaches the threshold; a null text counts as an empty one, and equal
    texts share their fate."""
    return quality.keep(docs)


def toxicity_filter(spark, docs, sf_dir):
    """Drops the documents that the positive-unlabelled classifier calls toxic; a null or empty text is scored by the
    bias alone. Null ids are not trained on; without toxic labels all documents stay."""
    columns = docs.columns
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.toDF(*columns), model, out="toxicity")
    return scored.where(scored[scored.columns[-1]] < toxicity.THRESHOLD).select(*columns)


def near_duplicates(spark, docs, sf_dir):
    """One document of each group of near-duplicates stays, the one with the least id; null texts all stay."""
    return neardup.deduplicate(docs)


def source_mix(spark, docs, sf_dir):
    """Documents chosen to meet the token budget of each source, a null source being one too; null and empty texts cost
    nothing and stay, ties of the seeded hash go by id."""
    return mixing.mix(docs)


def bpe_encode(spark, docs, sf_dir):
    """Token ids of every document, and the text that they decode to; both null where the text is."""
    return bpe.decode(bpe.encode(docs))


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("near duplicates", near_duplicates),
    ("source mix", source_mix),
    ("bpe", bpe_encode),
]

#: The classifier and the knapsack have no SQL; tests/llm compares each of the five operators with a brute-force version
#: or, for the quality rules, with SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``; each result is written to the shared folder and read by the next stage."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs

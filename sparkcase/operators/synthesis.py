"""Prompts as expressions over ranked results, and the hook that calls a text generator."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .retrieval import rank


def default_prompt(scores: DataFrame, instructions: str | Column = "", encode: Callable[[Column], Column] = lambda c: F.to_json(F.struct(c)), metadata: Callable[[Column], Column] | None = None) -> DataFrame:
    """``(query_id, prompt)``: instructions, the query, and the documents in the order of their rank."""
    ranked = scores if "rank" in scores.columns else rank(scores)
    block = F.concat(F.lit("### "), F.col("case_id").cast("string"), F.format_string(" (Rank: %d, Similarity: %.3f)\n\n", F.col("rank"), F.floor(F.col("sim") * 1000 + 0.5) / 1000), encode(F.col("case")))
    docs = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("text")))), lambda r: r["text"]), "\n\n")
    extra = [F.first(metadata(F.col("query"))).alias("metadata")] if metadata else []
    out = ranked.groupBy("query_id").agg(docs.alias("docs"), F.first("query").alias("query"), *extra)
    head = F.lit(instructions) if isinstance(instructions, str) else instructions
    parts = [F.when(head != "", F.concat(head, F.lit("\n\n"))).otherwise(""), F.lit("## Query\n\n"), encode(F.col("query")), F.lit("\n\n## Documents Collection\n\n"), F.col("docs")]
    if metadata:
        parts += [F.lit("\n\n## Metadata\n\n"), F.col("metadata")]
    return out.select("query_id", F.concat(*parts).alias("prompt"))


def concat_prompts(*prompts: DataFrame, separator: str = "\n\n") -> DataFrame:
    out = prompts[0]
    for i, other in enumerate(prompts[1:]):
        out = out.join(other.withColumnRenamed("prompt", f"p{i}"), "query_id").select("query_id", F.concat("prompt", F.lit(separator), f"p{i}").alias("prompt"))
    return out


def pooling_prompt(partial: DataFrame, instructions: str = "") -> DataFrame:
    """``(query_id, prompt)`` over partial responses ``(query_id, chunk, response)``."""
    block = F.concat(F.lit("### Result "), (F.col("chunk") + 1).cast("string"), F.lit("\n\n"), F.col("response"))
    docs = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", block.alias("text")))), lambda r: r["text"]), "\n\n")
    head = instructions + "\n\n" if instructions else ""
    return partial.groupBy("query_id").agg(F.concat(F.lit(head + "## Partial Results\n\n"), docs).alias("prompt"))


def chunks(scores: DataFrame, size: int, overlap: int = 0, direction: str = "both") -> DataFrame:
    """Cuts each query's ranking into chunks of ``size``: rows with ``chunk``, and those of a neighbour that overlap."""
    if size < 1:
        raise ValueError("size must be at least 1")
    placed = rank(scores).withColumn("chunk", F.floor((F.col("rank") - 1) / size)).withColumn("at", (F.col("rank") - 1) % size)
    last = F.max("chunk").over(Window.partitionBy("query_id"))
    rows_in = F.count("*").over(Window.partitionBy("query_id", "chunk"))
    placed = placed.withColumn("last", last).withColumn("rows_in", rows_in)
    none = F.lit(None).cast("bigint")
    left = F.when((F.col("at") >= F.col("rows_in") - overlap) & (F.col("chunk") < F.col("last")), F.col("chunk") + 1) if overlap and direction in ("both", "left") else none
    right = F.when((F.col("at") < overlap) & (F.col("chunk") > 0), F.col("chunk") - 1) if overlap and direction in ("both", "right") else none
    return placed.withColumn("chunk", F.explode(F.array_compact(F.array(F.col("chunk"), left, right)))).drop("at", "last", "rows_in")


def generate(prompts: DataFrame, generator: Callable[[str], str], retries: int = 2, delay: float = 0.0, default: str | None = None) -> DataFrame:
    """``(query_id, prompt, response, duration)`` from a Python callable, with retries and a default once they fail."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for prompt in pdf.prompt:
                began, response = time.monotonic(), default
                for attempt in range(retries + 1):
                    try:
                        response = generator(prompt)
                        break
                    except Exception:
                        if attempt == retries and default is None:
                            raise
                        time.sleep(delay)
                rows.append((response, time.monotonic() - began))
            yield pdf.assign(response=[r[0] for r in rows], duration=[r[1] for r in rows])

    kind = prompts.schema["query_id"].dataType.simpleString()
    return prompts.select("query_id", "prompt").mapInPandas(run, f"query_id {kind}, prompt string, response string, duration double")


def pipe(*generators: Callable[[str], str]) -> Callable[[str], str]:
    def run(prompt: str) -> str:
        for g in generators:
            prompt = g(prompt)
        return prompt

    return run


def conversation(generator: Callable[[str], str], next_prompt: Callable[[str], str | None]) -> Callable[[str], str]:
    """Asks again with what ``next_prompt`` makes of the response, until it gives none."""

    def run(prompt: str) -> str:
        while True:
            response = generator(prompt)
            following = next_prompt(response)
            if following is None:
                return response
            prompt = following

    return run

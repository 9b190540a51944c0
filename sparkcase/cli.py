"""Command line: ``python -m sparkcase.cli retrieve|reuse|cycle|synthesis`` over files, with operators named ``module:object``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import phases, retrieval, synthesis
from .sources import dumpers, loaders


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="sparkcase")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("retrieve", "reuse", "cycle", "synthesis"):
        p = commands.add_parser(name)
        p.add_argument("casebase")
        p.add_argument("queries")
        p.add_argument("--key", default="key", help="key column of both files")
        if name == "reuse":
            p.add_argument("--reuser", action="append", required=True, metavar="MODULE:OBJECT")
        else:
            p.add_argument("--retriever", action="append", required=True, metavar="MODULE:OBJECT")
        p.add_argument("--output", required=True, help="a path that ends in .json, .csv or .parquet")
        if name == "cycle":
            for kind in ("reuser", "reviser", "retainer"):
                p.add_argument(f"--{kind}", action="append", default=[], metavar="MODULE:OBJECT")
        if name == "synthesis":
            p.add_argument("--generator", required=True, metavar="MODULE:OBJECT")
            p.add_argument("--instructions", default="")
    return parser


def main(arguments: list[str] | None = None) -> None:
    args = _parser().parse_args(arguments)
    spark = SparkSession.builder.appName("sparkcase").getOrCreate()
    cases = retrieval.cases_of(loaders.path(spark, args.casebase), args.key)
    queries = retrieval.queries_of(loaders.path(spark, args.queries), args.key)
    retrievers = [loaders.py(n) for n in getattr(args, "retriever", ())]
    if args.command == "reuse":
        out = phases.apply_phase(retrieval.pairs(cases, queries), [loaders.py(n) for n in args.reuser]).final
    elif args.command == "cycle":
        out = phases.cycle(cases, queries, retrievers, *([loaders.py(n) for n in getattr(args, k)] for k in ("reuser", "reviser", "retainer"))).final
    else:
        out = retrieval.apply_queries(cases, queries, retrievers).final
    if args.command == "synthesis":
        prompts = synthesis.default_prompt(out, args.instructions)
        dumpers.file(synthesis.generate(prompts, loaders.py(args.generator)), args.output)
    else:
        dumpers.file(out.select("query_id", "case_id", "rank", "sim", F.col("case")), args.output)


if __name__ == "__main__":
    main()

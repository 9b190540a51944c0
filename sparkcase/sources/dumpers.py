"""Sinks: rows out as JSON, CSV, YAML, TOML, Markdown or Parquet; large outputs are written by Spark in parallel."""

from __future__ import annotations

import json as _json
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flatten(df: DataFrame) -> DataFrame:
    """Nested structs as columns ``a.b``."""

    def leaves(schema, path):
        for f in schema.fields:
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, (*path, f.name))
            else:
                yield (*path, f.name)

    return df.select(*(F.col(".".join(f"`{p}`" for p in path)).alias(".".join(path)) for path in leaves(df.schema, ())))


def csv(df: DataFrame, path: str) -> None:
    flatten(df).write.csv(path, header=True, mode="overwrite")


def json(df: DataFrame, path: str) -> None:
    df.write.json(path, mode="overwrite", ignoreNullFields=True)


def parquet(df: DataFrame, path: str) -> None:
    df.write.parquet(path, mode="overwrite")


def as_json(*columns) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "true"})


def markdown(value: Column, language: str = "json") -> Column:
    """A fenced code block around a dump."""
    return F.concat(F.lit(f"```{language}\n"), value, F.lit("\n```"))


def _records(df: DataFrame, key: str) -> dict:
    return {r[key]: {k: v for k, v in r.asDict(recursive=True).items() if k != key and v is not None} for r in df.toLocalIterator()}


def yaml(df: DataFrame, path: str, key: str = "key") -> None:
    """One document by key, written by the driver: for small tables."""
    import yaml as y

    Path(path).write_text(y.safe_dump(_records(df, key), sort_keys=False, allow_unicode=True))


def toml(df: DataFrame, path: str, key: str = "key") -> None:
    """Tables by key, written by the driver: for small tables of plain values."""

    def value(v):
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, dict):
            return "{" + ", ".join(f"{_json.dumps(str(k))} = {value(x)}" for k, x in v.items()) + "}"
        if isinstance(v, list):
            return "[" + ", ".join(map(value, v)) + "]"
        return repr(v) if isinstance(v, int | float) else _json.dumps(str(v), ensure_ascii=False)

    lines = []
    for k, record in _records(df, key).items():
        lines += [f"[{_json.dumps(str(k))}]", *(f"{_json.dumps(str(n))} = {value(v)}" for n, v in record.items()), ""]
    Path(path).write_text("\n".join(lines))


WRITERS = {".json": json, ".csv": csv, ".yaml": yaml, ".yml": yaml, ".toml": toml, ".parquet": parquet}


def file(df: DataFrame, path: str) -> None:
    suffix = Path(path).suffix
    if suffix not in WRITERS:
        raise ValueError(f"files with the suffix {suffix!r} can't be written")
    WRITERS[suffix](df, path)


def directory(df: DataFrame, path: str, key: str = "key", value: str = "value") -> None:
    """One file a row, named by ``key``, with the text ``value``; written row by row by the driver, so for small tables."""
    Path(path).mkdir(parents=True, exist_ok=True)
    for row in df.select(F.col(f"`{key}`").cast("string"), F.col(f"`{value}`").cast("string")).toLocalIterator():
        (Path(path) / row[0]).write_text(row[1] or "")


def path(df: DataFrame, where: str, **how) -> None:
    """A file if the path has a known suffix, else a directory of files."""
    if Path(where).suffix in WRITERS:
        file(df, where)
    else:
        directory(df, where, **how)

"""Sources: each gives a DataFrame with ``key`` and the record's columns; formats that Spark reads are read by Spark."""

from __future__ import annotations

import csv as csv_module
import importlib
import io
import json
import sqlite3
import tomllib
from collections.abc import Mapping
from pathlib import Path
from typing import Any
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame) -> DataFrame:
    """Adds ``key`` 0..n-1 in reading order: rows are counted for each partition, offsets added, nothing is gathered."""
    spark, tagged = df.sparkSession, df.select(F.spark_partition_id().alias("p_"), F.monotonically_increasing_id().alias("m_"), "*")
    counts = tagged.groupBy("p_").count()
    total = F.sum("count").over(Window.orderBy("p_").rowsBetween(Window.unboundedPreceding, -1))
    offsets = spark.createDataFrame(counts.select("p_", F.coalesce(total, F.lit(0)).alias("o_")).collect(), "p_ int, o_ long")
    return tagged.join(F.broadcast(offsets), "p_").select((F.col("m_") - F.shiftleft(F.col("p_").cast("long"), 33) + F.col("o_")).alias("key"), *(F.col(f"`{c}`") for c in df.columns))


def from_pandas(spark: SparkSession, pdf) -> DataFrame:
    return spark.createDataFrame(pdf.reset_index(drop=True).assign(key=range(len(pdf))))


def from_polars(spark: SparkSession, frame) -> DataFrame:
    """A polars frame with ``key`` 0..n-1, handed over as Arrow."""
    rows = frame.to_arrow()
    return spark.createDataFrame(rows.append_column("key", pa.array(range(rows.num_rows), pa.int64())))


def from_records(spark: SparkSession, records) -> DataFrame:
    """Records of a list, or of a mapping by key, as JSON-typed rows."""
    items = records.items() if isinstance(records, Mapping) else enumerate(records)
    lines = [json.dumps({"key": k, **v} if isinstance(v, Mapping) else {"key": k, "value": v}, default=str) for k, v in items]
    if not lines:
        return spark.createDataFrame([], "key string")
    array = spark.range(1).select(F.schema_of_json(F.lit("[" + ",".join(lines) + "]"))).first()[0]
    texts = spark.createDataFrame([(x,) for x in lines], "value string")
    return texts.select(F.from_json("value", array[len("ARRAY<") : -1]).alias("r")).select("r.*")


def csv(spark: SparkSession, path: str, infer: bool = True) -> DataFrame:
    return numbered(spark.read.csv(path, header=True, inferSchema=infer))


def json_(spark: SparkSession, path: str) -> DataFrame:
    """A list of records gets keys 0..n-1, an object of records its own keys; anything else is an error.

    Only the first line is looked at to tell them apart; a list is parsed by Spark.
    """
    start = spark.read.text(path).where(F.trim("value") != "").first()
    first = start[0].lstrip()[:1] if start else ""
    if first == "[":
        return numbered(spark.read.json(path, multiLine=True))
    if first == "{":
        return from_records(spark, json.loads(_text(spark, path)))
    raise TypeError("a list or an object of records is needed")


def _text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def toml(spark: SparkSession, path: str) -> DataFrame:
    return from_records(spark, tomllib.loads(_text(spark, path)))


def _yaml_rows(text: str) -> dict:
    import yaml as y

    rows: dict[Any, Any] = {}
    for doc in y.safe_load_all(text):
        if isinstance(doc, list):
            rows.update({len(rows) + i: v for i, v in enumerate(doc)})
        elif isinstance(doc, dict):
            rows.update(doc)
        else:
            raise TypeError("lists or objects of records are needed")
    return rows


def yaml(spark: SparkSession, path: str) -> DataFrame:
    """Lists of several documents get running keys, objects are merged."""
    return from_records(spark, _yaml_rows(_text(spark, path)))


def xml_value(node: ElementTree.Element):
    """An element as text, or as an object of its attributes (``@name``), children and text (``#text``); a repeated
    child is a list, an empty element null."""
    out: dict[str, Any] = {"@" + k: v for k, v in node.attrib.items()}
    for child in node:
        value = xml_value(child)
        if child.tag in out:
            out[child.tag] = [*(out[child.tag] if isinstance(out[child.tag], list) else [out[child.tag]]), value]
        else:
            out[child.tag] = value
    text = (node.text or "").strip()
    if not out:
        return text or None
    return {**out, "#text": text} if text else out


def xml(spark: SparkSession, path: str, row_tag: str | None = None) -> DataFrame:
    """With ``row_tag`` one row for each such element, read by Spark; without it the parts of the single root by name."""
    if row_tag is not None:
        return numbered(spark.read.format("xml").option("rowTag", row_tag).load(path))
    parts = xml_value(ElementTree.fromstring(_text(spark, path)))
    return from_records(spark, parts if isinstance(parts, dict) else {"#text": parts})


def txt(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


_SUFFIXES = {".csv": csv, ".json": json_, ".toml": toml, ".yaml": yaml, ".yml": yaml}


def file(spark: SparkSession, path: str, **how) -> DataFrame:
    suffix = Path(path).suffix
    if suffix == ".xml":
        return xml(spark, path, **how)
    if suffix not in _SUFFIXES:
        raise ValueError(f"files with the suffix {suffix!r} can't be read")
    return _SUFFIXES[suffix](spark, path, **how)


def _as_json(suffix: str, text: str) -> str:
    """The content of a file as JSON; plain text as it is."""
    if suffix == "txt":
        return text
    if suffix == "json":
        value = json.loads(text)
    elif suffix == "toml":
        value = tomllib.loads(text)
    elif suffix in ("yaml", "yml"):
        value = _yaml_rows(text)
    elif suffix == "xml":
        value = xml_value(ElementTree.fromstring(text))
    else:
        value = dict(enumerate(csv_module.DictReader(io.StringIO(text))))
    return json.dumps(value, default=str, ensure_ascii=False)


#: Suffixes of files that ``directory`` reads.
READABLE = ("txt", "json", "toml", "yaml", "yml", "xml", "csv")


def directory(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files as ``(key, value)``: the file name without suffix, and what the file holds, parsed by its suffix and given
    as JSON; plain text stays text. Other files are passed over. A task holds one file at a time."""
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    files = spark.read.text(f"{path}/{pattern}", wholetext=True).select(name.alias("name"), "value")
    suffix = F.lower(F.regexp_extract("name", r"\.([^.]*)$", 1))
    parse = F.pandas_udf(lambda kinds, texts: pd.Series([_as_json(k, t) for k, t in zip(kinds, texts)], dtype=object), "string")
    known = files.select(F.regexp_replace("name", r"\.[^.]*$", "").alias("key"), suffix.alias("suffix"), "value").where(F.col("suffix").isin(*READABLE))
    return known.select("key", parse("suffix", "value").alias("value"))


def path(spark: SparkSession, where: str, **how) -> DataFrame:
    p = Path(where)
    if p.is_file():
        return file(spark, where, **how)
    if p.is_dir():
        return directory(spark, where, **how)
    raise FileNotFoundError(where)


def py(name: str) -> Any:
    """The object ``module:name``."""
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def sqlite(spark: SparkSession, database: str, sql: str, parameters=()) -> DataFrame:
    with sqlite3.connect(f"file:{database}?mode=ro", uri=True) as connection:
        cursor = connection.execute(sql, parameters)
        names = [d[0] for d in cursor.description]
        return from_records(spark, [dict(zip(names, row)) for row in cursor])


def sql(spark: SparkSession, query: str, **views: DataFrame) -> DataFrame:
    """A query over the given views, run by Spark."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return spark.sql(query)


def jdbc(spark: SparkSession, url: str, query: str, **options) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def validate(df: DataFrame, rules: Mapping[str, str], strict: bool = True) -> DataFrame:
    """Checks SQL conditions by name: a row that breaks one is an error, or, unless strict, gets it in ``violations``."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(F.expr(rule), F.lit(False)), F.lit(name)) for name, rule in rules.items())))
    if not strict:
        return df.withColumn("violations", broken)
    return df.where(F.when(F.size(broken) > 0, F.raise_error(F.concat(F.lit("invalid row: "), F.array_join(broken, ", "))).cast("boolean")).otherwise(True))

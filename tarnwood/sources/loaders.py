"""Reading corpora, query sets and judgements."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _numbered(df: DataFrame, order: str | None = None) -> DataFrame:
    """Adds doc_id 0.. in the order of the file: of splits, and of rows within them."""
    # the number holds the split in its upper bits; a row a split comes to the driver
    placed = df.select(F.monotonically_increasing_id().alias("at_"), *[f"`{c}`" for c in df.columns])
    offsets, total = [], 0
    for r in placed.groupBy(F.shiftright("at_", 33).alias("split_")).count().orderBy("split_").collect():
        offsets.append((r["split_"], total))
        total += r["count"]
    shift = F.broadcast(df.sparkSession.createDataFrame(offsets, "split_ bigint, shift_ bigint"))
    doc_id = F.col("at_").bitwiseAND((1 << 33) - 1) + F.col("shift_")
    return placed.join(shift, F.shiftright("at_", 33) == F.col("split_")).select(doc_id.alias("doc_id"), *[f"`{c}`" for c in df.columns])


def _pick(df: DataFrame, column: str | None) -> DataFrame:
    """text from the named column, or from the first."""
    column = column or df.columns[0]
    if column not in df.columns:
        raise ValueError(f"no column {column!r}; there are {', '.join(df.columns)}")
    return df.withColumn("__t", F.col(column).cast("string")).drop(*({"text"} - {column} & set(df.columns))).select(F.col("__t").alias("text"), *[c for c in df.columns if c not in (column, "text", "doc_id")])


def load_txt(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text): a document a line, trimmed, blank lines dropped."""
    lines = spark.read.text(path).select(F.regexp_replace("value", r"^\s+|\s+$", "").alias("text"))
    return _numbered(lines.where("text <> ''"))


def load_json(spark: SparkSession, path: str, column: str | None = None) -> DataFrame:
    """A JSON file that is a list of strings or of objects."""
    whole = spark.read.text(path, wholetext=True)
    kind = whole.select(F.substring(F.regexp_replace("value", r"^[\s﻿]+", ""), 1, 1).alias("c"), F.regexp_extract("value", r"^\s*\[\s*(.)", 1).alias("d")).first()
    if kind is None or kind.c != "[":
        raise ValueError("the JSON file must hold a list")
    if kind.d == "]":
        return spark.createDataFrame([], "doc_id bigint, text string")
    if kind.d == '"':
        items = whole.select(F.posexplode(F.from_json("value", "array<string>")).alias("doc_id", "text"))
        return items.select(F.col("doc_id").cast("bigint"), "text")
    first = json.loads(whole.select(F.from_json("value", "array<string>")[0]).first()[0])
    rows = spark.read.option("multiLine", True).json(path)
    return _numbered(_pick(rows, column or next(iter(first))))


def load_jsonl(spark: SparkSession, path: str, column: str | None = None) -> DataFrame:
    """A JSON object a line, blank lines dropped; the column is by default the first key of the first line."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    head = lines.first()
    if head is None:
        return spark.createDataFrame([], "doc_id bigint, text string")
    column = column or next(iter(json.loads(head.value)))
    rows = spark.read.json(path)
    picked = _pick(rows, column)
    if not rows.where(F.col(column).isNull()).isEmpty():
        raise ValueError(f"a line lacks the key {column!r}")
    return _numbered(picked)


def load_csv(spark: SparkSession, path: str, column: str | None = None) -> DataFrame:
    """A CSV file with a header; the column is by default the first. A file without a header has no rows."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if not rows.columns:
        raise ValueError("the CSV file has no header")
    return _numbered(_pick(rows, column))


def load(spark: SparkSession, path: str, column: str | None = None) -> DataFrame:
    """Documents of a .txt, .json, .jsonl, .csv or .parquet file, with doc_id."""
    suffix = Path(path).suffix.lower()
    if suffix == ".txt":
        return load_txt(spark, path)
    if suffix == ".parquet":
        df = spark.read.parquet(path)
        return df if "doc_id" in df.columns else _numbered(_pick(df, column))
    try:
        reader = {".json": load_json, ".jsonl": load_jsonl, ".csv": load_csv}[suffix]
    except KeyError:
        raise ValueError(f"can't read {suffix or 'a file without suffix'}; use .txt, .json, .jsonl, .csv or .parquet") from None
    return reader(spark, path, column)


def documents(spark: SparkSession, items: Iterable[object]) -> DataFrame:
    """(doc_id, text, payload) of strings or dicts held by the driver; a dict's text is its "text". Ids are positions; entries of other kinds are skipped and leave a gap."""
    rows = []
    for i, x in enumerate(items):
        if isinstance(x, str):
            rows.append((i, x, None))
        elif isinstance(x, (dict, list, tuple)):
            text = str(x["text"]) if isinstance(x, dict) and "text" in x else ""
            rows.append((i, text, json.dumps(x, ensure_ascii=False)))
    return spark.createDataFrame(rows, "doc_id bigint, text string, payload string")


def lookup(docs: DataFrame, ids: int | slice | Sequence[int]) -> DataFrame:
    """Documents at an id, a slice of ids or a list of ids; for Parquet the filter reaches the scan."""
    if isinstance(ids, bool) or isinstance(ids, str):
        raise TypeError("an id is an integer, a slice or a list of integers")
    if isinstance(ids, int):
        return docs.where(F.col("doc_id") == ids)
    if isinstance(ids, slice):
        if ids.step not in (None, 1):
            start = ids.start or 0
            docs = docs.where((F.col("doc_id") - start) % ids.step == 0)
        if ids.start is not None:
            docs = docs.where(F.col("doc_id") >= ids.start)
        return docs.where(F.col("doc_id") < ids.stop) if ids.stop is not None else docs
    return docs.where(F.col("doc_id").isin([int(i) for i in ids]))


def load_records(spark: SparkSession, path: str, force_title: bool = False, remove: Sequence[str] = ()) -> DataFrame:
    """A collection's corpus or queries: JSON lines with _id, as (id, ...). Columns in ``remove`` must be there."""
    df = spark.read.json(path)
    missing = set(remove) - set(df.columns)
    if missing:
        raise KeyError(f"no column {', '.join(sorted(missing))}")
    df = df.drop(*remove)
    if force_title and "title" not in df.columns:
        df = df.withColumn("title", F.lit(None).cast("string"))
    return df.withColumnRenamed("_id", "id")


def load_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """(id, title, text, ...) of a collection's folder."""
    return load_records(spark, f"{folder}/corpus.jsonl", force_title=True)


def load_queries(spark: SparkSession, folder: str) -> DataFrame:
    return load_records(spark, f"{folder}/queries.jsonl")


def load_qrels(spark: SparkSession, folder: str, split: str = "test", last_per_query: bool = False) -> DataFrame:
    """(query_id, doc_id, rel) of a collection's judgements; last_per_query keeps the last line of each query only."""
    if split not in ("train", "dev", "test"):
        raise ValueError(f"unknown split {split!r}")
    df = spark.read.csv(f"{folder}/qrels/{split}.tsv", sep="\t", header=True, schema="query_id string, doc_id string, rel int")
    if last_per_query:
        at = df.withColumn("n", F.monotonically_increasing_id())
        last = Window.partitionBy("query_id").orderBy(F.col("n").desc())
        df = at.withColumn("r", F.row_number().over(last)).where("r = 1").drop("n", "r")
    return df


def merge_collections(spark: SparkSession, folder: str, what: str = "corpus") -> DataFrame:
    """The corpora or queries of all sub-folders in one, ids prefixed with the folder's name."""
    df = spark.read.json(f"{folder}/*/{what}.jsonl")
    name = F.regexp_extract(F.input_file_name(), rf"([^/]+)/{what}\.jsonl$", 1)
    return df.withColumn("id", F.concat_ws("_", name, F.col("_id").cast("string"))).drop("_id")


def merge_judgements(spark: SparkSession, folder: str, split: str = "test") -> DataFrame:
    """The judgements of all sub-folders, both ids prefixed with the folder's name."""
    df = spark.read.csv(f"{folder}/*/qrels/{split}.tsv", sep="\t", header=True, schema="query_id string, doc_id string, rel int")
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)/qrels/[^/]+$", 1)
    return df.select(F.concat_ws("_", name, "query_id").alias("query_id"), F.concat_ws("_", name, "doc_id").alias("doc_id"), "rel")


def with_title(df: DataFrame) -> DataFrame:
    """text with the title before it."""
    return df.withColumn("text", F.concat_ws(" ", "title", "text"))


def prefix_union(parts: dict[str, DataFrame], id_col: str = "doc_id") -> DataFrame:
    """A union in which ids carry the name of their part."""
    out = None
    for name, df in parts.items():
        named = df.withColumn(id_col, F.concat_ws("_", F.lit(name), F.col(id_col).cast("string")))
        out = named if out is None else out.unionByName(named, allowMissingColumns=True)
    return out

"""A corpus pipeline: documents to packed training windows.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet
and read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnwood.llm import line_dedup, mixing, packing, ppm_langid, simhash_trie
from tarnwood.llm.common import fresh_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that some language's context tree compresses."""
    return ppm_langid.identify(docs, keep=True)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the later copies of repeated line runs; documents left without a line go."""
    return line_dedup.line_dedup(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates."""
    return simhash_trie.near_dedup(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats the smaller sources up to twice; every document is used once at least."""
    return mixing.mix(docs, keep=True)


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into windows, with their text."""
    return packing.pack(docs, with_text=True)


STAGES = [("language_id", language_id), ("line_dedup", lines), ("simhash_near_dedup", near_duplicates), ("temperature_mix", mixture), ("packing", windows)]

#: Context trees, tries and the packing recursion aren't SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        at = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return docs

"""Tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it names none, a temporary folder in local mode, as in tests, and an error on a cluster."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tarnwood-"))
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/tarnwood-{what}-{uuid.uuid4().hex}"


def staged(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as Parquet and read again: computed once, and safe from lost executors."""
    at = fresh_path(df.sparkSession, what)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def token_slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 1_000_000) -> Iterator[tuple[pa.Array, pa.ListArray]]:
    """doc_id and the lists of ``column``, about ``most`` tokens or one row at a time."""
    for b in batches:
        ids, lists = b.column("doc_id"), b.column(column)
        ends = np.cumsum(np.diff(lists.offsets.to_numpy()))
        at = 0
        while at < b.num_rows:
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
            yield ids.slice(at, stop - at), lists.slice(at, stop - at)
            at = stop


def running_total(df: DataFrame, order: list[str], value: str | None = None, name: str = "before") -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` (or the count) over all rows that precede in ``order``, without one task that sees all.

    Rows are sorted by range, each range adds up its own, and the ranges' totals, a number a
    task, are added in the driver. ``order`` must be of columns that together differ from row to row, or ties are cut as they come.
    """
    spark = df.sparkSession
    columns = df.columns
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.LongType()), T.StructField("range_", T.IntegerType()), T.StructField("own_", T.LongType())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, own = 0, TaskContext.get().partitionId()
        for b in batches:
            n = b.num_rows
            v = np.ones(n, np.int64) if value is None else b.column(columns.index(value)).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = total + np.cumsum(v)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ends - v), pa.array(np.full(n, own, np.int32)), pa.array(v)], schema.names)
            total = int(ends[-1]) if n else total

    each = staged(df.repartitionByRange(*[F.col(f"`{c}`").asc_nulls_last() for c in order]).sortWithinPartitions(*[F.col(f"`{c}`").asc_nulls_last() for c in order]).mapInArrow(add, schema), "ranges")
    offsets, at = [], 0
    for r in each.groupBy("range_").agg(F.sum("own_").alias("n")).orderBy("range_").collect():  # a row a task
        offsets.append((r["range_"], at))
        at += r.n
    shift = F.broadcast(spark.createDataFrame(offsets, "range_ int, shift_ bigint"))
    return each.join(shift, "range_").select(*[f"`{c}`" for c in columns], (F.col(name) + F.col("shift_")).alias(name))

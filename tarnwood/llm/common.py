"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.staging import fresh_path

#: Edges whose components one task finds.
TASK_EDGES = 500_000


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a table written by :func:`written`."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, what: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    It cuts the lineage: what is read later survives the loss of an executor.
    """
    spark = df.sparkSession
    path = path or fresh_path(spark, what)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_hash(text: Column) -> Column:
    """With the id this names a document: ids may repeat with other texts."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def rows_keyed(docs: DataFrame) -> DataFrame:
    """(row, d, k): each row as a struct, its id and text hash, so that no column of docs can clash with a helper."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(row.alias("row"), F.col("doc_id").cast("bigint").alias("d"), text_hash(F.col("text").cast("string")).alias("k"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def block_pairs(rows: DataFrame, member: str, most: int) -> DataFrame:
    """``rows`` of groups of n, with (part, i, j) added: all pairs of a group, in tasks (group, i, j) of about 2 * ``most`` rows.

    A group of more than ``most`` is cut into parts by the hash of its members, and each
    row goes to the tasks of its part with every part. A pair of two parts meets in the one task of both; those
    within part i are to be compared in the task (i, i) only.
    """
    parts = F.ceil(F.col("n") / F.lit(most)).cast("int")
    cut = rows.withColumn("part", F.pmod(F.xxhash64(member), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    return cut.withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other")).drop("other")


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int = 20_000) -> Iterator[pa.Table]:
    """Batches sorted by ``key``, joined and cut so that no group of one key is split; about ``rows`` rows at a time."""
    held, n, want = [], 0, rows
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n < want:
            continue
        t = pa.Table.from_batches(held)
        k = t[key].to_numpy()
        other = np.flatnonzero(k != k[-1])
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            yield t.slice(0, cut)
            t = t.slice(cut)
        held, n = t.to_batches(), t.num_rows
        want = max(rows, 2 * n)
    if n:
        yield pa.Table.from_batches(held)


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of each component of the edges a, b among 0..n-1."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def _task_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Node and root, of the edges of a single partition."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    t = pa.Table.from_batches(held)
    node, at = np.unique(np.concatenate([t["a"].to_numpy(), t["b"].to_numpy()]), return_inverse=True)
    root = local_roots(len(node), at[: t.num_rows], at[t.num_rows :])
    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(node[root])], ["node", "root"])


def components(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """Connected components of edges(a, b): (node, root), the root being the least node.

    Up to ``task_edges`` edges are joined in one task, as every round below leaves plans, stages and generated
    code in the driver. More go by rounds. Each round, a node's greater neighbours move to the least of it and its neighbours (large star), then a node's
    lesser neighbours and itself move to the least of those (small star), until every component is a star around
    its least node. Chains, whatever the order of their ids, take about the logarithm of their length in rounds. Each round
    is written, as a plan that carries its estimated size from round to round doubles the digits of that number.
    """
    pairs = written(edges.select("a", "b"), "edges")
    if pairs.count() <= task_edges:
        return written(pairs.repartition(1).mapInArrow(_task_roots, "node bigint, root bigint"), "roots")
    stars = pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    stars = written(stars.withColumn("moved", F.lit(True)), "stars")
    while not stars.where("moved").isEmpty():
        links = stars.select("a", "b")
        least = links.union(links.select("b", "a")).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("m"))
        large = links.join(least, F.col("b") == F.col("node")).groupBy("a", F.col("m").alias("b")).agg(F.max(F.col("m") < F.col("b")).alias("moved"))
        large = written(large, "stars")
        first = large.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"), F.max("moved").alias("moved"))
        others = large.select("a", "b").join(first.select("node", "m"), F.col("a") == F.col("node")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"), F.lit(True).alias("moved"))
        small = first.select(F.col("node").alias("a"), F.col("m").alias("b"), "moved").union(others)
        stars = written(small.groupBy("a", "b").agg(F.max("moved").alias("moved")), "stars")
    found = stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
    alone = pairs.where("a = b").select(F.col("a").alias("node"), F.col("b").alias("root"))
    return written(found.union(stars.select("b", "b")).union(alone).groupBy("node").agg(F.min("root").alias("root")), "roots")

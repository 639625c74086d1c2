"""Merkle fixity audit of record stores.

Records, in the order of their key, are hashed into leaves; ``fanout`` neighbouring
slots make a range, ranges make ranges, up to one root. Slots are distances from the least key, or 48 bits of a digest of a key that is no number, so a lost or added
record disturbs only its own branch; a node's hash covers its children's numbers, lengths in bytes and hashes, so where they lie too. Replicas are compared from the root: at each level
only the children of nodes that differ are looked at, so that with few faults little more
than a path a fault is read. Hashing is a narrow map, the tree a chain of partial
aggregates over hashes of 32 bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written


def _col(c: str) -> Column:
    return F.col(f"`{c}`")


def _tagged(c: str) -> Column:
    """The value behind its length in bytes, so that no other row of values reads the same; null differs from empty."""
    text = _col(c).cast("string")
    return F.when(text.isNull(), F.lit("n")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def record_hash(columns: list[str]) -> Column:
    return F.sha2(F.concat(F.lit(""), *[_tagged(c) for c in columns]), 256)


def leaves(records: DataFrame, key: str, columns: list[str], low: int, high: int, fanout: int, hashed: bool) -> DataFrame:
    """(slot, hash, bytes, key, file, offset_start, offset_end) of each key: its records' hashes, ordered, hashed again.

    A file is fanout**2 slots; offsets are running bytes within it, in the order of slots.
    """
    size = sum((F.coalesce(F.octet_length(_col(c).cast("string")), F.lit(0)) for c in columns), F.lit(0)).cast("bigint")
    text = _col(key).cast("string")
    slot = F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("bigint") if hashed else _col(key).cast("bigint") - F.lit(low)
    slot = F.coalesce(slot, F.lit(high - low + 1))
    rows = records.select(slot.cast("bigint").alias("slot"), record_hash(columns).alias("h"), size.alias("bytes"), (text if hashed else _col(key).cast("bigint")).alias("key"))
    leaf = rows.groupBy("slot").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ","), 256).alias("hash"), F.sum("bytes").alias("bytes"), F.min("key").alias("key"))
    leaf = leaf.withColumn("file", F.floor(F.col("slot") / F.lit(fanout**2)).cast("bigint"))
    own = Window.partitionBy("file").orderBy("slot")
    end = F.sum("bytes").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return leaf.withColumn("offset_end", end).withColumn("offset_start", F.col("offset_end") - F.col("bytes"))


def _parents(nodes: DataFrame, fanout: int) -> DataFrame:
    """The level above: hashes of the children's numbers, lengths and hashes, in order."""
    children = F.array_sort(F.collect_list(F.struct("node", "bytes", "hash")))
    listed = F.array_join(F.transform(children, lambda c: F.concat(c.node.cast("string"), F.lit(":"), c.bytes.cast("string"), F.lit(":"), c.hash)), ",")
    return nodes.groupBy(F.floor(F.col("node") / F.lit(fanout)).cast("bigint").alias("up")).agg(F.sha2(listed, 256).alias("hash"), F.sum("bytes").alias("bytes"), F.min("file").alias("file"), F.min("offset_start").alias("offset_start"), F.max("offset_end").alias("offset_end")).withColumnRenamed("up", "node")


def audit(a: DataFrame, b: DataFrame, key: str = "page_id", columns: list[str] | None = None, fanout: int = 64) -> DataFrame:
    """The branches in which replica ``b`` differs from ``a``, from the root down to records.

    (level, node, status, key, file, offset_start, offset_end, n_bytes): level 0 are
    records. status: "differs", "lost" (a has it only) or "extra" (b only). For ranges up to a
    file the bytes they take in their file in the replica that has them, a's before b's; above, null offsets
    and file. Equal replicas give no rows.

    columns: what is hashed, all by default in the order of their names. Records of a null key share
    one slot after all others. Records of one key are hashed together whatever their order,
    so that repeated rows count, and so are those whose digests agree in 48 bits; the least of their keys is told. Keys that aren't whole
    numbers, or lie 2**62 or more apart, are digested and told as text; the order of records is then that of digests. Column names may hold dots. Null and empty values differ. Empty against empty: no rows; against a filled
    replica: everything is lost or extra. Columns that b lacks raise an error.
    """
    columns = columns or sorted(a.columns)
    used = [_col(key), *[_col(c) for c in columns if c != key]]
    a, b = a.select(*used), b.select(*used)
    hashed = not all(isinstance(x.schema[key].dataType, T.IntegralType) for x in (a, b))
    low, high = 0, 2**48 - 1
    if not hashed:
        span = a.select(_col(key).cast("bigint").alias("k")).union(b.select(_col(key).cast("bigint").alias("k"))).agg(F.min("k").alias("a"), F.max("k").alias("b")).first()
        hashed = span.a is not None and span.b - span.a >= 2**62
        if not hashed:
            low, high = (0, 0) if span.a is None else (span.a, span.b)
    height = 1
    while fanout**height < high - low + 2:
        height += 1
    trees = []
    for name, replica in (("a", a), ("b", b)):
        level = written(leaves(replica, key, columns, low, high, fanout, hashed).withColumnRenamed("slot", "node"), f"merkle-{name}-0")
        tree = [level]
        for i in range(1, height + 1):
            level = written(_parents(level, fanout), f"merkle-{name}-{i}")
            tree.append(level)
        trees.append(tree)

    found, frontier = [], None
    for i in range(height, -1, -1):
        sides = [t[i] for t in trees]
        if frontier is not None:
            sides = [s.join(frontier, F.floor(F.col("node") / F.lit(fanout)).cast("bigint") == F.col("up"), "left_semi") for s in sides]
        x, y = sides[0].alias("x"), sides[1].alias("y")
        both = x.join(y, F.col("x.node") == F.col("y.node"), "full_outer").where(~F.col("x.hash").eqNullSafe(F.col("y.hash")))
        pick = lambda c: F.coalesce(F.col(f"x.{c}"), F.col(f"y.{c}"))
        whole = F.lit(i <= 2)
        rows = both.select(
            F.lit(i).alias("level"), pick("node").alias("node"),
            F.when(F.col("y.hash").isNull(), "lost").when(F.col("x.hash").isNull(), "extra").otherwise("differs").alias("status"),
            (pick("key") if i == 0 else F.lit(None).cast("string" if hashed else "bigint")).alias("key"),
            F.when(whole, pick("file")).alias("file"), F.when(whole, pick("offset_start")).alias("offset_start"), F.when(whole, pick("offset_end")).alias("offset_end"), pick("bytes").alias("n_bytes"),
        )
        rows = written(rows, f"merkle-diff-{i}")
        found.append(rows)
        frontier = rows.select(F.col("node").alias("up"))
    out = found[0]
    for r in found[1:]:
        out = out.union(r)
    return out


def with_faults(records: DataFrame, key: str = "page_id", column: str = "html", seed: str = "fixity") -> DataFrame:
    """A replica with faults that the key decides: about 1 in 256 records lost, 1 in 256 changed.

    It stands for a second store in the query; tests plant their own.
    """
    draw = F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("-")))), 1, 2)
    return records.where(draw != "ff").withColumn(column, F.when(draw == "00", F.concat(F.lit("\u0001"), F.coalesce(F.col(column), F.lit("")))).otherwise(F.col(column)))

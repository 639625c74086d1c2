"""Embedding near-dedup by lattice hashing in E8.

In each table a random projection takes the unit vectors to ``blocks`` times eight dimensions, scaled by
the cell width, and each eight are decoded to their nearest point of the lattice E8 (the union of
D8 and D8 shifted by one half); the points of all blocks together are a cell. A vector is
stored in its own cell and looked up in that and in the ``probes`` nearest others that differ
from it by one of the 240 shortest lattice vectors in some blocks.

Only cells and ids are shuffled until it is known where a vector meets another; the few vectors that
do are sent to those cells and their cosines computed there, so no pair is
shuffled before it is verified. A cell of many vectors is cut into blocks whose pairs are tasks of
their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .common import block_pairs, components, local_roots, whole_groups, written

#: vectors of a cell that one task compares with one another
CELL_ROWS = 4096
#: the same where all vectors are compared
ALL_ROWS = 16_384
#: nearest neighbours of a block's point that are combined with those of the other blocks
NEAR = 6


def neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8, doubled to be whole."""
    found = []
    for i, j in combinations(range(8), 2):
        for a, b in product((-2, 2), repeat=2):
            v = [0] * 8
            v[i], v[j] = a, b
            found.append(v)
    found += [s for s in product((-1, 1), repeat=8) if s.count(-1) % 2 == 0]
    return np.array(found, np.int64)


def _decode_d8(x: np.ndarray) -> np.ndarray:
    """Nearest point of D8: whole coordinates of even sum."""
    y = np.rint(x)
    odd = np.flatnonzero(y.sum(1) % 2)
    if len(odd):
        gap = x[odd] - y[odd]
        worst = np.abs(gap).argmax(1)
        y[odd, worst] += np.where(gap[np.arange(len(odd)), worst] >= 0, 1, -1)
    return y


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest point of E8 to each row, doubled to be whole."""
    a, b = _decode_d8(x), _decode_d8(x - 0.5) + 0.5
    near = ((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1)
    return np.rint(2 * np.where(near[:, None], a, b)).astype(np.int64)


def cells(x: np.ndarray, probes: int, salt: int = 0) -> np.ndarray:
    """Hashes of the own cell and of the nearest ``probes`` others of each row of x, of eight columns a block."""
    around, count = neighbours(), x.shape[1] // 8
    near_n = min(NEAR, probes)
    points, cost = [], np.zeros((len(x), 1))
    for k in range(count):
        part = x[:, 8 * k : 8 * k + 8]
        own = decode(part)
        # |gap - v/2|^2 = |gap|^2 + 2 - gap.v for the shortest vectors v/2, all of norm 2
        more = 2 - (part - own / 2) @ around.T
        near = np.argsort(more, axis=1)[:, :near_n]
        points.append(np.concatenate([own[:, None, :], own[:, None, :] + around[near]], axis=1))
        more = np.concatenate([np.zeros((len(x), 1)), np.take_along_axis(more, near, 1)], axis=1)
        cost = (cost[:, :, None] + more[:, None, :]).reshape(len(x), -1)
    n = min(probes + 1, cost.shape[1])
    best = np.argpartition(cost, n - 1, axis=1)[:, :n]
    own_first = np.where(best == 0, -1.0, np.take_along_axis(cost, best, 1))
    best = np.take_along_axis(best, np.argsort(own_first, axis=1, kind="stable"), 1)
    chosen = []
    for k in range(count - 1, -1, -1):
        chosen.append(np.take_along_axis(points[k], (best % (near_n + 1))[:, :, None], 1))
        best = best // (near_n + 1)
    flat = (np.concatenate(chosen[::-1], axis=2).reshape(-1) + (1 << 20)).astype(np.uint64)
    at = np.arange(0, len(flat), 8 * count)
    h = kernels.spans_hash(flat, at, at + 8 * count)
    return kernels.mix(h ^ np.uint64(salt)).reshape(len(x), -1).view(np.int64)


def projections(dim: int, tables: int, blocks: int, seed: int) -> np.ndarray:
    """For each table, eight orthonormal directions a block."""
    rng = np.random.default_rng(seed)
    wide = 8 * blocks
    return np.stack([np.linalg.qr(rng.standard_normal((dim, wide)))[0] if dim >= wide else rng.standard_normal((dim, wide)) / np.sqrt(dim) for _ in range(tables)])


def _by_length(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows of each length, and their values as a matrix."""
    size = np.diff(lists.offsets.to_numpy())
    flat, begin = lists.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(size))
    for dim in np.unique(size):
        rows = np.flatnonzero(size == dim)
        yield rows, flat[begin[rows][:, None] + np.arange(dim)]


def _first_meeting(own_cells: np.ndarray, other_cells: np.ndarray, swap: np.ndarray, tables: int) -> np.ndarray:
    """For pairs of vectors, given all cells of both: a number of the meeting that counts, 2 * table + (1 if the greater one owns the cell)."""
    n = own_cells.shape[1] // tables
    x, y = (z.reshape(len(z), tables, n) for z in (own_cells, other_cells))
    mine, theirs = (x[:, :, :1] == y).any(2), (y[:, :, :1] == x).any(2)
    # the lesser one's cell is looked at before the greater one's
    lesser, greater = np.where(swap[:, None], theirs, mine), np.where(swap[:, None], mine, theirs)
    return np.stack([lesser, greater], axis=2).reshape(len(x), -1).argmax(1)


def _meet(t: pa.Table, threshold: float, tables: int) -> pa.RecordBatch:
    """Of the pairs in each group (cell, i, j), of one of the cell's own vectors and another, that reach the threshold: a forest that links them, and each vector's number of pairs that count here."""
    cell, i, j, side, node, table = (t[c].to_numpy() for c in ("c", "i", "j", "part", "node", "t"))
    own = t["own"].to_numpy(zero_copy_only=False).astype(bool)
    vectors, places = (t[c].combine_chunks() for c in ("v", "cells"))
    order = np.lexsort((j, i, cell))
    same = np.zeros(len(order), bool)
    same[1:] = True
    for x in (cell, i, j):
        same[1:] &= x[order][1:] == x[order][:-1]
    first = np.append(np.flatnonzero(~same), len(order))
    flat, begin = vectors.flatten().to_numpy(), vectors.offsets.to_numpy() - vectors.offsets[0].as_py()
    held, held_at = places.flatten().to_numpy(), places.offsets.to_numpy() - places.offsets[0].as_py()
    matrix = lambda values, at, rows: values[at[rows][:, None] + np.arange(at[rows[0] + 1] - at[rows[0]])]
    out = []
    for lo, hi in zip(first[:-1], first[1:]):
        rows = order[lo:hi]
        mine = np.flatnonzero(own[rows])
        if not len(mine) or len(rows) < 2:
            continue
        m, lists, ids = matrix(flat, begin, rows), matrix(held, held_at, rows), node[rows]
        links, a, b = np.zeros(len(rows), np.int64), [], []
        for at in range(0, len(mine), 512):
            some = mine[at : at + 512]
            ok = m[some] @ m.T >= threshold
            # pairs of two parts in the task of both, those within a part in that of the part; two of the cell's own once
            ok &= (side[rows][some][:, None] != side[rows][None, :]) | (i[rows[0]] == j[rows[0]])
            ok &= np.where(own[rows][None, :], ids[some][:, None] < ids[None, :], ids[some][:, None] != ids[None, :])
            x, y = np.nonzero(ok)
            x = some[x]
            a.append(x)
            b.append(y)
            for part in range(0, len(x), 100_000):
                p, q = x[part : part + 100_000], y[part : part + 100_000]
                swap = ids[p] > ids[q]
                meeting = 2 * table[rows[0]] + (swap & ~own[rows][q])
                counts = _first_meeting(lists[p], lists[q], swap, tables) == meeting
                links += np.bincount(p[counts], minlength=len(rows)) + np.bincount(q[counts], minlength=len(rows))
        root = local_roots(len(rows), np.concatenate(a), np.concatenate(b))
        keep = (links > 0) | (root != np.arange(len(rows)))
        out.append((ids[keep], ids[root[keep]], links[keep]))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64)) for k in range(3)], ["node", "root", "links"])


def similar_vectors(vectors: DataFrame, threshold: float = 0.95, tables: int = 6, probes: int = 10, cell: float = 0.25, blocks: int = 3, seed: int = 11, id_col: str = "vec_id", vec_col: str = "embedding", exact: bool = False) -> DataFrame:
    """(vec_id, class_id, links, copies), a row for each different row of ``vectors``.

    Vectors of cosine ``threshold`` or more are linked; links: the number of other vectors, equal
    ones counted once, that it is linked to; copies: the number of other rows with the same
    vector. A class is what is connected by links and copies, class_id its least id. Pairs are counted where they meet
    and only forests leave a task, so a class of n vectors costs no n * n rows.

    Approximate: a pair is missed if no table brings it together; tests measure the recall. cell: width of the
    lattice, in the length of the projected unit vectors; probes: other cells that a
    query looks into; blocks: lattice points a cell, fewer where a vector has less than eight parts for each.
    exact: all vectors of a dimension share one cell, so every pair is compared, block by block: time grows with the square.

    Null vectors, vectors with null or infinite parts, zero vectors and null ids resemble
    nothing and are left out. Vectors of different dimensions aren't compared. Repeated
    rows are one; one id with several vectors has a row for each. Empty table: no rows.
    """
    spark = vectors.sparkSession
    slim = vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("v")).where("id is not null and v is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
    slim = slim.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).where("norm > 0").withColumn("node", F.xxhash64("v", F.reverse("v")))
    rows = written(slim.groupBy("id", "node").agg(F.first(F.transform("v", lambda x: x / F.col("norm"))).alias("v")), "vectors")
    names = rows.groupBy("node").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    heads = rows.join(names.select(F.col("node").alias("m"), "first"), (F.col("node") == F.col("m")) & (F.col("id") == F.col("first"))).select("node", "v")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, x in _by_length(b.column("v")):
                dim = x.shape[1]
                many = min(blocks, -(-dim // 8))
                found = np.concatenate([cells((x @ p) / cell, probes, (dim << 20) + t) for t, p in enumerate(projections(dim, tables, many, seed + dim))], axis=1)
                take = pa.array(at)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * found.shape[1]), pa.array(found.reshape(-1)))
                yield pa.RecordBatch.from_arrays([b.column("node").take(take), b.column("v").take(take), lists], ["node", "v", "cells"])

    if exact:
        tables, heads = 1, heads.withColumn("cells", F.array(F.size("v").cast("bigint")))
    heads = written(heads if exact else heads.mapInArrow(hashed, "node bigint, v array<double>, cells array<bigint>"), "vector-cells")
    wide = F.size("cells") / F.lit(tables)
    routed = heads.select("node", wide.cast("int").alias("w"), F.posexplode("cells").alias("pos", "c")).select("c", "node", F.floor(F.col("pos") / F.col("w")).cast("int").alias("t"), (F.col("pos") % F.col("w") == 0).alias("own"))
    held = routed.groupBy("c").agg(F.count("*").alias("n"), F.max("own").alias("any")).where("n > 1 and any").select(F.col("c").alias("c2"), "n")
    met = block_pairs(routed.join(held, F.col("c") == F.col("c2")).select("c", "node", "t", "own", "n"), "node", ALL_ROWS if exact else CELL_ROWS)
    full = met.join(heads.withColumnRenamed("node", "m"), F.col("node") == F.col("m")).select(F.xxhash64("c", "i", "j").alias("g"), "c", "i", "j", "part", "t", "own", "node", "v", "cells")
    compare = lambda batches: (_meet(t, threshold, tables) for t in whole_groups(batches, "g", 5_000))
    found = written(full.repartition("g").sortWithinPartitions("g").mapInArrow(compare, "node bigint, root bigint, links bigint"), "vector-links")
    roots = components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("rn"), "root")
    links = found.groupBy(F.col("node").alias("ln")).agg(F.sum("links").alias("links"))
    grouped = names.join(roots, F.col("node") == F.col("rn"), "left").join(links, F.col("node") == F.col("ln"), "left").select("node", "first", "n", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    least = grouped.groupBy(F.col("root").alias("r2")).agg(F.min("first").alias("class_id"))
    grouped = grouped.join(least, F.col("root") == F.col("r2")).select(F.col("node").alias("gn"), "class_id", "links", (F.col("n") - 1).alias("copies"))
    return rows.select("id", "node").join(grouped, F.col("node") == F.col("gn")).select(F.col("id").alias("vec_id"), "class_id", "links", "copies")

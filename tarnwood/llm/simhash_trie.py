"""SimHash near-dedup: a binary trie joined with itself.

A document's words (lower-cased runs of letters and digits) are hashed, weighted by
1 + ln(count) and folded into a 64-bit SimHash. Distinct fingerprints form a binary
trie; pairs of its nodes are descended together, the differing bits of the path are
added up, and a pair of subtrees is dropped when they exceed the budget.

The bits fall into budget + 1 blocks. If two fingerprints differ in at most ``budget``
bits, then some rotation of the blocks exists from which on every prefix of j blocks
holds at most j * budget / (budget + 1) differing bits (the cycle lemma). So the trie is
kept in one rotation per block, a node pair is pruned as soon as it exceeds its prefix's
share, and, as the first block then allows no difference, the subtrees below it are
joined only with themselves. As the corpus grows, these subtrees are cut at deeper prefixes within
the second block, where one difference is allowed: a fingerprint belongs to its own prefix and visits those
that have one more bit set, so that each pair of subtrees within the budget meets in one place. What
is still too large (many equal fingerprints) is cut into parts, and each pair of parts is a task.
The join is exact.

Texts of one language share their frequent words, so some unrelated ones come as close in them as
copies do, and their number grows with the square of the corpus. So a document has two prints: 64 bits over its
words and 128 over its runs of three words, where unrelated texts differ in half of the bits. Two documents
are near-duplicates if they differ in at most ``budget`` bits of the first and ``SKETCH_BITS`` of the second; all
such pairs are found, those of equal first prints too. That is a measure of likeness, as any SimHash is, not a proof of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .common import block_pairs, components, local_roots, rows_keyed, text_hash, whole_groups, written

BITS = 64
#: differing bits, of the 128 over runs of words, of a near-duplicate: 64 is what unrelated texts have, about 36 what
#: texts have of whose word pairs two in three are common
SKETCH_BITS = 42


def _majority(h: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """The bits that most of the hashes of each group have, groups beginning at edge."""
    size = np.diff(np.append(edge, len(h)))
    ones = np.add.reduceat(np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), edge, axis=0, dtype=np.int32)
    return np.packbits(2 * ones > size[:, None], axis=1, bitorder="little").view("<u8").reshape(-1)


def _sketch(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of the 128 bits of each row that has words; h: hashes of its words, in order."""
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    n = np.diff(np.append(first, len(row)))
    with np.errstate(over="ignore"):
        g = h.copy()
        g[:-2] += h[1:-1] * np.uint64(0x9E3779B97F4A7C15) + h[2:] * np.uint64(0xC2B2AE3D27D4EB4F)
        g = kernels.mix(g)
    # a row gives its runs of three words; one of less, its words
    whole = np.ones(len(h), bool)
    long = n >= 3
    whole[(first + n - 1)[long]] = False
    whole[(first + n - 2)[long]] = False
    short = np.repeat(~long, n)
    g[short] = h[short]
    g = g[whole]
    edge = np.append(0, np.cumsum(np.where(long, n - 2, n)))[:-1]
    return _majority(g, edge), _majority(kernels.mix(g ^ np.uint64(0x5851F42D4C957F2D)), edge)


def fingerprints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """SimHash of each text as int64, its number of words, and its sketch (two int64 a row)."""
    out, size, sketch = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.int64), np.zeros((len(texts), 2), np.uint64)
    for first, data, offsets in kernels.chunks(texts, lower=True):
        starts, ends = kernels.runs(kernels.WORD[data], offsets)
        if not len(starts):
            continue
        h = kernels.spans_hash(data, starts, ends)
        row = kernels.rows_of(starts, offsets)
        sketch[first + row[np.flatnonzero(np.append(True, row[1:] != row[:-1]))]] = np.stack(_sketch(h, row), axis=1)
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        at = np.flatnonzero(new)
        weight = (1 + np.log(np.diff(np.append(at, len(h))))).astype(np.float32)
        h, row = h[at], row[at]
        edge = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        ids = row[edge]
        value = np.zeros(len(edge), np.uint64)
        for b in range(BITS):
            bit = ((h >> np.uint64(b)) & np.uint64(1)).astype(bool)
            value |= (np.add.reduceat(np.where(bit, weight, -weight), edge) > 0).astype(np.uint64) << np.uint64(b)
        out[first + ids] = value
        size[first : first + len(offsets) - 1] += np.diff(np.searchsorted(starts, offsets))
    return out.view(np.int64), size, sketch.view(np.int64)


def blocks(budget: int) -> list[int]:
    """Where the budget + 1 blocks of the 64 bits begin, and 64."""
    m = min(budget + 1, BITS)
    return [round(i * BITS / m) for i in range(m + 1)]


def _rotations(budget: int) -> list[tuple[int, np.ndarray]]:
    """For each rotation: the bits it moves to the end, and the most differences by depth."""
    cut, m = blocks(budget), min(budget + 1, BITS)
    found = []
    for r in range(m):
        widths = [cut[(r + j) % m + 1] - cut[(r + j) % m] for j in range(m)]
        allowed = np.full(BITS + 1, budget)
        depth = 0
        for j, w in enumerate(widths):
            depth += w
            # within block j no more than at its end; deeper blocks allow more
            allowed[depth - w + 1 : depth + 1] = (j + 1) * budget // m
        found.append((cut[r], allowed))
    return found


def rotate(x: np.ndarray, by: int) -> np.ndarray:
    x = x.astype(np.uint64)
    return x if by % 64 == 0 else (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def trie_self_join(values: np.ndarray, allowed: np.ndarray, group: np.ndarray, verify=None) -> tuple[np.ndarray, np.ndarray]:
    """All i < j of sorted uint64 values that differ within ``allowed`` at every depth; equal values are pairs too.

    The sorted array is the trie: a node of depth d is a range of equal first d bits.
    group: begins of ranges whose pairs of nodes are joined separately (all share their
    first bits). verify: of arrays i and j, which pairs count.
    """
    begin, end = group[:-1].astype(np.int64), group[1:].astype(np.int64)
    own = end - begin > 1
    a0, a1 = begin[own], end[own]
    frontier = (a0, a1, a0.copy(), a1.copy(), np.zeros(len(a0), np.int16))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    pieces = [(0, frontier)]
    one = np.uint64(1)
    while pieces:
        depth, (a0, a1, b0, b1, err) = pieces.pop()
        small = ((a1 - a0) * (b1 - b0) <= 16) | (depth >= BITS)
        if small.any():
            found += _leaves(values, allowed, a0[small], a1[small], b0[small], b1[small], verify)
        big = ~small
        if not big.any():
            continue
        a0, a1, b0, b1, err = (x[big] for x in (a0, a1, b0, b1, err))
        shift = np.uint64(BITS - 1 - depth)
        ones = np.concatenate([[0], np.cumsum((values >> shift) & one).astype(np.int64)])
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        same = (a0 == b0) & (a1 == b1)
        kids = [(a0, am, b0, bm, err), (am, a1, bm, b1, err), (a0, am, bm, b1, err + 1), (am[~same], a1[~same], b0[~same], bm[~same], err[~same] + 1)]
        nxt = tuple(np.concatenate([k[i] for k in kids]) for i in range(5))
        live = (nxt[0] < nxt[1]) & (nxt[2] < nxt[3]) & (nxt[4] <= allowed[depth + 1]) & ~((nxt[0] == nxt[2]) & (nxt[1] == nxt[3]) & (nxt[1] - nxt[0] == 1))
        nxt = tuple(x[live] for x in nxt)
        for at in range(0, len(nxt[0]), 1 << 20):  # bounds memory, drops nothing
            pieces.append((depth + 1, tuple(x[at : at + (1 << 20)] for x in nxt)))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _leaves(values, allowed, a0, a1, b0, b1, verify):
    """Pairs of small or equal node pairs, compared on the whole path at once, a bounded number at a time."""
    na, nb = a1 - a0, b1 - b0
    count = na * nb
    total = np.cumsum(count)
    out, at, step = [], 0, 1 << 20
    while at < total[-1]:
        k = np.arange(at, min(at + step, int(total[-1])))
        of = np.searchsorted(total, k, "right")
        k = k - (total[of] - count[of])
        i, j = a0[of] + k // nb[of], b0[of] + k % nb[of]
        ok = (i < j) & (np.bitwise_count(values[i] ^ values[j]) <= allowed[BITS])
        i, j = i[ok], j[ok]
        if verify is not None and len(i):
            ok = verify(i, j)
            i, j = i[ok], j[ok]
        out.append((i, j))
        at += step
    return out


def _first_rotation(diff: np.ndarray, budget: int) -> np.ndarray:
    """The first rotation whose prefix shares each difference keeps; the one that emits the pair."""
    cut, m = blocks(budget), min(budget + 1, BITS)
    per = np.stack([np.bitwise_count(rotate(diff, cut[b]) >> np.uint64(BITS - (cut[b + 1] - cut[b]))).astype(np.int16) for b in range(m)])
    first = np.full(len(diff), -1)
    for r in range(m):
        total, ok = np.zeros(len(diff), np.int16), np.ones(len(diff), bool)
        for j in range(m):
            total = total + per[(r + j) % m]
            ok &= total <= (j + 1) * budget // m
        first[(first < 0) & ok] = r
    return first


def similar_pairs(prints: DataFrame, budget: int, forest: bool = False, task_rows: int = 100_000) -> DataFrame:
    """Pairs of different nodes of prints(node, fp) within ``budget`` bits of fp: (a, b, distance), a < b; all of them, or with forest as many as connect the same nodes.

    With columns s1 and s2, the halves of a sketch, only pairs within SKETCH_BITS of each other there. node must be unique; fp may repeat.
    task_rows: rows of a prefix of the trie that are aimed at; prefixes of twice as many are cut into parts.
    """
    sketched = [c for c in ("s1", "s2") if c in prints.columns]
    rotations = _rotations(budget)
    cut = blocks(budget)
    m = len(rotations)
    # bits of the second block by which prefixes grow longer, so that they hold about task_rows; 0 or 1 difference is allowed up to its end
    rows = max(1, prints.count())
    first_width = cut[1] - cut[0]
    most = min(cut[(r + 1) % m + 1] - cut[(r + 1) % m] for r in range(m)) if budget and m > 1 and 2 * budget // m <= 1 else 0
    extra = min(most, max(0, (rows // (task_rows << first_width)).bit_length()))
    keys = []
    for r in range(m):
        turn, width = cut[r], cut[r + 1] - cut[r]
        turned = F.shiftleft("fp", turn).bitwiseOR(F.shiftrightunsigned("fp", BITS - turn)) if turn else F.col("fp")
        prefix = F.shiftrightunsigned(turned, BITS - width - extra)
        entry = lambda p, own, r=r: F.struct(F.lit(r).alias("r"), p.alias("prefix"), F.lit(own).alias("own"))
        keys.append(entry(prefix, True))
        keys += [F.when(prefix.bitwiseAND(1 << b) == 0, entry(prefix.bitwiseOR(1 << b), False)) for b in range(extra)]
    routed = prints.select("node", "fp", *sketched, F.explode(F.filter(F.array(*keys), lambda k: k.isNotNull())).alias("k")).select("node", "fp", *sketched, "k.*")
    counts = routed.groupBy("r", "prefix").agg(F.count("*").alias("n")).select(F.col("r").alias("r2"), F.col("prefix").alias("p2"), "n").where("n > 1")
    tasks = block_pairs(routed.join(counts, (F.col("r") == F.col("r2")) & (F.col("prefix") == F.col("p2"))), "node", 2 * task_rows)
    tasks = tasks.select(F.xxhash64("r", "prefix", "i", "j").alias("g"), "r", "i", "j", "part", "own", "node", "fp", *sketched)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "g", task_rows):
            turns, g = t["r"].to_numpy(), t["g"].to_numpy()
            for r in np.unique(turns):
                turn, allowed = rotations[r]
                mine = np.flatnonzero(turns == r)
                values = rotate(t["fp"].to_numpy()[mine].view(np.uint64), turn)
                order = np.lexsort((values, g[mine]))
                mine, values = mine[order], values[order]
                node, part, i_part, j_part = (t[c].to_numpy()[mine] for c in ("node", "part", "i", "j"))
                own = t["own"].to_numpy()[mine].astype(bool)
                sketch = [t[c].to_numpy()[mine].view(np.uint64) for c in sketched]
                group = np.append(np.flatnonzero(np.append(True, g[mine][1:] != g[mine][:-1])), len(values))

                def verify(i, j, own=own, part=part, i_part=i_part, j_part=j_part, sketch=sketch, values=values, r=r, turn=turn):
                    ok = (own[i] | own[j]) & ((part[i] != part[j]) | (i_part[i] == j_part[i]))
                    if sketch:
                        ok &= sum(np.bitwise_count(x[i] ^ x[j]).astype(np.int16) for x in sketch) <= SKETCH_BITS
                    w = np.flatnonzero(ok)
                    ok[w] = _first_rotation(rotate(values[i[w]] ^ values[j[w]], 64 - turn), budget) == r
                    return ok

                i, j = trie_self_join(values, allowed, group, verify)
                if forest and len(i):
                    root = local_roots(len(node), i, j)
                    j = np.flatnonzero(root != np.arange(len(root)))
                    i = root[j]
                a, b = node[i], node[j]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(np.bitwise_count(values[i] ^ values[j]).astype(np.int32))], ["a", "b", "distance"])

    return tasks.repartition("g").sortWithinPartitions("g").mapInArrow(join, "a bigint, b bigint, distance int")


def duplicates(docs: DataFrame, budget: int = 8) -> DataFrame:
    """Near-duplicates of docs(doc_id, text): (doc_id, text_key, keep_doc_id, keep_text_key, fingerprint, keep_fingerprint).

    Documents that are linked by steps of at most ``budget`` differing bits of the words' print and SKETCH_BITS of that of
    runs of words form a group; its first document by (doc_id, hash of the text), null ids last,
    stays, and each other document is a row naming the one that stays.

    A text without a word, empty or null, resembles nothing. Null ids: compared like
    others. Repeated rows with one id and one text: a single document, as no copy could be
    told from the other. Empty table: no rows.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, size, sketch = fingerprints(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array(fp), pa.array(sketch[:, 0]), pa.array(sketch[:, 1])], ["doc_id", "text_key", "fp", "s1", "s2"]).filter(pa.array(size > 0))

    scanned = slim.select("doc_id", "text", text_hash(F.col("text")).alias("text_key")).mapInArrow(scan, "doc_id bigint, text_key bigint, fp bigint, s1 bigint, s2 bigint")
    prints = written(scanned.withColumn("node", F.xxhash64("fp", "s1", "s2")), "simhash")
    nodes = written(prints.groupBy("node", "fp", "s1", "s2").agg(F.count("*").alias("n")).drop("n"), "simhash-nodes")
    roots = components(written(similar_pairs(nodes, budget, forest=True).select("a", "b"), "simhash-edges"))
    grouped = prints.join(roots.withColumnRenamed("node", "m"), F.col("node") == F.col("m"), "left").select("doc_id", "text_key", "fp", F.coalesce("root", "node").alias("root"))
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_key", "fp")
    best = grouped.groupBy(F.col("root").alias("g")).agg(F.min(order).alias("k"), F.count("*").alias("members")).where("members > 1")
    out = grouped.join(best, F.col("root") == F.col("g")).where(~(F.col("doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("text_key") == F.col("k.text_key"))))
    return out.select("doc_id", "text_key", F.col("k.doc_id").alias("keep_doc_id"), F.col("k.text_key").alias("keep_text_key"), F.col("fp").alias("fingerprint"), F.col("k.fp").alias("keep_fingerprint")).distinct()


def near_dedup(docs: DataFrame, budget: int = 8) -> DataFrame:
    """``docs`` without its near-duplicates, all columns kept. Every row of the document that stays, stays."""
    gone = duplicates(docs, budget).select(F.col("doc_id").alias("gd"), F.col("text_key").alias("gk"))
    rest = rows_keyed(docs).join(gone, F.col("d").eqNullSafe(F.col("gd")) & (F.col("k") == F.col("gk")), "left_anti")
    return rest.select(*[F.col("row")[c].alias(c) for c in docs.columns])

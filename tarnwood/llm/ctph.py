"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash of seven bytes ends a chunk wherever it is -1 modulo the block size; each
chunk gives one of 64 signature characters, so an edit changes the characters near it
only. The block size is the least 3 * 2**i that gives at most 64 chunks, halved while
the signature has less than 32. A second signature is made at twice the block size, so
that documents whose block sizes differ by a factor of two can be compared.

Signatures are candidates if they share seven neighbouring characters at one block size, and are
scored by edit distance (insertions and deletions), bit-parallel over all candidates. A pair that shares several such
grams counts where the least of them meets, so once; what leaves a task are each text's number of partners, its
best one and a forest that links them, not the pairs. A gram of many texts is cut into parts whose pairs are tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .common import block_pairs, components, local_roots, whole_groups, written

ROLL = 7
LONG, SHORT, GRAM = 64, 32, 7
#: texts of one gram that one task compares with one another
GRAM_ROWS = 2000
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)

CODE = np.zeros(256, np.uint8)
CODE[ALPHABET] = np.arange(64)


def _rolling(data: np.ndarray) -> np.ndarray:
    """A 32-bit hash of the seven bytes that end at each position."""
    h = np.zeros(len(data), np.uint32)
    spread = kernels.mix(np.arange(1, 257, dtype=np.uint64)).astype(np.uint32)[data]
    weight = np.uint32(1)
    with np.errstate(over="ignore"):
        for k in range(min(ROLL, len(data))):
            h[k:] += spread[: len(data) - k] * weight
            weight = np.uint32((int(weight) * 0x01000193) & 0xFFFFFFFF)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(12)
    return h


def _sign(data, offsets, rows, pos, row, value, block, most):
    """Signatures of at most ``most`` characters of the given rows, whose triggers are at pos."""
    hit = value % block[row] == block[row] - 1
    p, r = pos[hit], row[hit]
    rank = np.arange(len(r)) - np.searchsorted(r, r)
    p, r = p[rank < most - 1], r[rank < most - 1]
    size = np.diff(offsets)
    lastp = np.zeros(len(size), np.int64)
    np.maximum.at(lastp, r, p + 1)
    lastp = np.maximum(lastp, offsets[:-1])
    rest = (lastp < offsets[1:]) & rows
    ends = np.concatenate([p + 1, offsets[1:][rest]])
    own = np.concatenate([r, np.flatnonzero(rest)])
    order = np.lexsort((ends, own))
    ends, own = ends[order], own[order]
    starts = np.where(np.append(True, own[1:] != own[:-1]) if len(own) else np.zeros(0, bool), offsets[own], np.append(0, ends[:-1])) if len(own) else ends
    chars = ALPHABET[(kernels.spans_hash(data, starts, ends) & np.uint64(63)).astype(np.int64)] if len(own) else np.zeros(0, np.uint8)
    bound = np.searchsorted(own, np.arange(len(size) + 1))
    return chars, bound


def signatures(texts: pa.Array) -> tuple[np.ndarray, list[str], list[str]]:
    """Block size and both signatures of each text; an empty text has block size 0 and empty ones."""
    n = len(texts)
    blocks, one, two = np.zeros(n, np.int64), [""] * n, [""] * n
    for first, data, offsets in kernels.chunks(texts):
        size = np.diff(offsets)
        rows = size > 0
        h = _rolling(data)
        pos = np.flatnonzero(h % np.uint32(3) == 2)
        row = np.searchsorted(offsets, pos, "right") - 1
        full = pos - offsets[row] >= ROLL - 1
        pos, row = pos[full], row[full]
        value = h[pos].astype(np.int64)
        block = np.full(len(size), 3, np.int64)
        while (grow := block * LONG < size).any():
            block[grow] *= 2
        small = rows & (block > 3)
        while small.any():
            hit = value % block[row] == block[row] - 1
            count = np.bincount(row[hit], minlength=len(size)) + 1
            small &= (count < SHORT) & (block > 3)
            block[small] //= 2
        for signs, b, most in ((one, block, LONG), (two, block * 2, SHORT)):
            chars, bound = _sign(data, offsets, rows, pos, row, value, b, most)
            text = chars.tobytes().decode()
            for i in np.flatnonzero(rows):
                signs[first + i] = text[bound[i] : bound[i + 1]]
        blocks[first : first + len(size)] = np.where(rows, block, 0)
    return blocks, one, two


def squeeze(s: str) -> str:
    """Runs of more than three equal characters become three: they say little."""
    out: list[str] = []
    for c in s:
        if len(out) < 3 or not (out[-1] == out[-2] == out[-3] == c):
            out.append(c)
    return "".join(out)


class Signs:
    """Signatures as codes, and for each the places of each code as bits."""

    def __init__(self, signs: list[str]):
        n = len(signs)
        self.size = np.array([len(x) for x in signs], np.int64)
        self.codes = np.full((n, LONG), LONG, np.uint8)  # LONG: no character
        here = np.arange(LONG)[None, :] < self.size[:, None]
        self.codes[here] = CODE[np.frombuffer("".join(signs).encode(), np.uint8)]
        self.places = np.zeros((n, LONG + 1), np.uint64)
        row, col = np.nonzero(here)
        np.bitwise_or.at(self.places, (row, self.codes[row, col]), np.uint64(1) << col.astype(np.uint64))


def alike(x: Signs, y: Signs, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """100 * (1 - d / (a + b)), rounded down, of the pairs x[i], y[j] of a and b characters; d: insertions and deletions from one to the other.

    The longest common subsequence of up to 64 characters, a bit a character of x[i], for
    all pairs at once.
    """
    v = np.full(len(i), 0xFFFFFFFFFFFFFFFF, np.uint64)
    flat, base = x.places.reshape(-1), i * (LONG + 1)
    with np.errstate(over="ignore"):
        for t in range(int(y.size[j].max(initial=0))):
            u = v & flat[base + y.codes[j, t]]
            v = (v + u) | (v - u)
    la, total = x.size[i], x.size[i] + y.size[j]
    mask = np.where(la >= 64, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << np.minimum(la, 63).astype(np.uint64)) - np.uint64(1))
    lcs = np.bitwise_count(~v & mask).astype(np.int64)
    return np.where(total > 0, 100 * 2 * lcs // np.maximum(total, 1), 0)


def similarity(a: list[str], b: list[str]) -> np.ndarray:
    """:func:`alike` of a[k] and b[k]."""
    k = np.arange(len(a))
    return alike(Signs(a), Signs(b), k, k)


def grams(block: np.ndarray, one: list[str], two: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each different gram of seven characters at a block size."""
    short = [(squeeze(x), squeeze(y)) for x, y in zip(one, two)]
    # long ones that squeeze to few characters meet if they are equal
    few = [i for i, (x, y) in enumerate(short) if len(one[i]) >= GRAM > max(len(x), len(y))]
    whole = [f"{block[i]}|{one[i]}|{two[i]}" for i in few]
    end = np.cumsum([len(x) for x in whole], dtype=np.int64)
    found = [kernels.mix(kernels.spans_hash(np.frombuffer("".join(whole).encode(), np.uint8), np.append(0, end[:-1]).astype(np.int64), end))] if few else []
    rows = [np.array(few, np.int64)] if few else []
    for column, factor in ((0, 1), (1, 2)):
        signs = [x[column] for x in short]
        sizes = np.array([len(x) for x in signs], np.int64)
        flat = np.frombuffer("".join(signs).encode(), np.uint8)
        row, end = np.repeat(np.arange(len(signs)), sizes), np.cumsum(sizes)
        at = np.arange(len(flat))
        at = at[at + GRAM <= end[row]]
        if len(at):
            h = kernels.spans_hash(flat, at, at + GRAM)
            with np.errstate(over="ignore"):
                found.append(kernels.mix(h ^ (block[row[at]] * factor).astype(np.uint64)))
            rows.append(row[at])
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    both = np.unique(np.stack([np.concatenate(rows).astype(np.uint64), np.concatenate(found)]), axis=1)
    return both[1], both[0].astype(np.int64)


def _meets_earlier(held: np.ndarray, i: np.ndarray, j: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Whether held[i] and held[j], sorted grams of two texts, share one that is less than g."""
    out = np.zeros(len(i), bool)
    live = np.arange(len(i))
    for k in range(held.shape[1]):
        x = held[i[live], k]
        less = x < g[live]
        live, x = live[less], x[less]
        if not len(live):
            break
        found = (held[j[live]] == x[:, None]).any(1)
        out[live[found]] = True
        live = live[~found]
    return out


def _score(t: pa.Table, threshold: int) -> pa.RecordBatch:
    """(node, root, links, s, n, like, group) of the texts that have a partner here: the best by score, then by id."""
    nodes = t["node"].to_numpy()
    names, first, member = np.unique(nodes, return_index=True, return_inverse=True)
    head = t.select(["block_size", "first_doc", "signature", "signature2"]).take(pa.array(first))
    block, docs = head["block_size"].to_numpy(), head["first_doc"]
    none = docs.is_null().to_numpy(zero_copy_only=False)
    doc = docs.fill_null(0).to_numpy()
    signs = head["signature"].to_pylist(), head["signature2"].to_pylist()
    one, two = (Signs([squeeze(x) for x in c]) for c in signs)
    g_of, row = grams(block, *signs)
    most = int(np.bincount(row).max()) if len(row) else 1
    held = np.full((len(names), most), np.uint64(2**64 - 1))
    held[row, np.arange(len(row)) - np.searchsorted(row, row)] = g_of  # by row, then by hash
    g, i_part, j_part, part, task = (t[c].to_numpy() for c in ("g", "i", "j", "part", "task"))
    order = np.lexsort((member, task))
    task = task[order]
    starts = np.flatnonzero(np.append(True, task[1:] != task[:-1]))
    size = np.diff(np.append(starts, len(task)))
    left = np.repeat(starts + size, size) - 1 - np.arange(len(task))  # members of its group after each
    total = np.cumsum(left)
    a, b, score = [], [], []
    done = 0
    while done < len(task):  # in pieces, to bound memory
        stop = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + 250_000, "right")))
        mine = left[done:stop]
        x = np.repeat(np.arange(done, stop), mine)
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(mine) - mine, mine)
        x, y = order[x], order[y]
        ok = (g[x] == g[y]) & ((part[x] != part[y]) | (i_part[x] == j_part[x])) & (member[x] != member[y])
        x, y = x[ok], y[ok]
        # each pair of the piece once, with the least gram that it shares here
        code, met = member[x] * len(names) + member[y], g[x].view(np.uint64)
        by = np.lexsort((met, code))
        by = by[np.append(True, code[by][1:] != code[by][:-1])] if len(by) else by
        i, j, met = code[by] // len(names), code[by] % len(names), met[by]
        value = np.zeros(len(i), np.int64)
        for same, p, q in ((block[i] == block[j], one, one), (block[i] == block[j], two, two), (block[i] == 2 * block[j], one, two), (block[j] == 2 * block[i], two, one)):
            w = np.flatnonzero(same)
            value[w] = np.maximum(value[w], alike(p, q, i[w], j[w]))
        w = np.flatnonzero(value >= threshold)
        w = w[~_meets_earlier(held, i[w], j[w], met[w])]  # it counts where its least gram is
        a.append(i[w])
        b.append(j[w])
        score.append(value[w])
        done = stop
    a, b, score = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (a, b, score))
    root = local_roots(len(names), a, b)
    own, other, s = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([score, score])
    best = np.lexsort((names[other], doc[other], none[other], -s, own))
    best = best[np.append(True, own[best][1:] != own[best][:-1])] if len(best) else best
    links = np.bincount(own, minlength=len(names))[own[best]] if len(best) else own
    like = other[best]
    columns = [names[own[best]], names[root[own[best]]], links, -s[best], none[like], pa.array(doc[like], mask=none[like]), names[like]]
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], ["node", "root", "links", "s", "n", "like", "group"])


def fingerprints(docs: DataFrame, threshold: int = 60) -> DataFrame:
    """(doc_id, block_size, signature, signature2, like_doc_id, score, group, class_id, links), a row a document.

    group: documents of one group have the same text, by signature and hash. links: the number of other groups that
    resemble it at ``threshold`` or more. A class is what is connected by groups and links; class_id is the doc_id of its first document.
    like_doc_id: the document that resembles it most, by score and then by least id:
    the first document of the same text, at score 100, or for that first document the first of the
    best other group of at least ``threshold``; null and score 0 where there is none. Signatures of
    less than seven characters say too little: such texts resemble equal ones only.

    Null and empty text: block size 0, empty signatures, no group, class, links or likeness. Null ids: answered,
    after all others in the order of ids; a like_doc_id that is null has a score above 0.
    Repeated rows are answered each, and resemble the first document of their text; a document isn't compared with itself. Empty table: no rows.
    """
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            block, one, two = signatures(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(block), pa.array(one, pa.string()), pa.array(two, pa.string()), b.column("text_hash")], ["doc_id", "block_size", "signature", "signature2", "text_hash"])

    signed = written(slim.mapInArrow(scan, "doc_id bigint, block_size bigint, signature string, signature2 string, text_hash bigint"), "ctph")
    key = F.xxhash64("block_size", "signature", "signature2", "text_hash")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id"))
    nodes = signed.where("block_size > 0").groupBy(key.alias("node")).agg(first.alias("f"), F.first("block_size").alias("block_size"), F.first("signature").alias("signature"), F.first("signature2").alias("signature2"))
    nodes = written(nodes.select("node", F.col("f.doc_id").alias("first_doc"), "block_size", "signature", "signature2"), "ctph-nodes")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g, row = grams(b.column("block_size").to_numpy(), b.column("signature").to_pylist(), b.column("signature2").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), b.column("node").take(pa.array(row))], ["g", "node"])

    shared = nodes.select("node", "block_size", "signature", "signature2").mapInArrow(spread, "g bigint, node bigint")
    # most grams are those of one text only; signatures go to the few rows that meet another
    counts = shared.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select(F.col("g").alias("g2"), "n")
    met = block_pairs(shared.join(counts, F.col("g") == F.col("g2")).select("g", F.col("node").alias("at"), "n"), "at", GRAM_ROWS)
    full = met.join(nodes, F.col("at") == F.col("node")).select(F.xxhash64("g", "i", "j").alias("task"), "g", "i", "j", "part", "node", "first_doc", "block_size", "signature", "signature2")
    score = lambda batches: (_score(t, threshold) for t in whole_groups(batches, "task"))
    found = written(full.repartition("task").sortWithinPartitions("task").mapInArrow(score, "node bigint, root bigint, links bigint, s bigint, n boolean, like bigint, group bigint"), "ctph-links")
    sums = found.groupBy(F.col("node").alias("n2")).agg(F.sum("links").alias("links"), F.min(F.struct("s", "n", "like", "group")).alias("best"))
    roots = components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("n3"), "root")
    known = nodes.select("node", "first_doc").join(sums, F.col("node") == F.col("n2"), "left").join(roots, F.col("node") == F.col("n3"), "left").select("node", "first_doc", "links", "best", F.coalesce("root", "node").alias("root"))
    heads = known.groupBy(F.col("root").alias("r2")).agg(F.min(F.struct(F.col("first_doc").isNull().alias("n"), "first_doc")).alias("c"))
    known = known.join(heads, F.col("root") == F.col("r2")).select("node", "first_doc", "links", "best", F.col("c.first_doc").alias("class_id"))
    out = signed.withColumn("k", key).join(known, F.col("k") == F.col("node"), "left")
    later = F.col("node").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("first_doc"))
    like, value = F.when(later, F.col("first_doc")).otherwise(F.col("best.like")), F.when(later, F.lit(100)).otherwise(F.coalesce(-F.col("best.s"), F.lit(0)))
    return out.select("doc_id", "block_size", "signature", "signature2", like.alias("like_doc_id"), value.cast("bigint").alias("score"), F.col("node").alias("group"), "class_id", F.coalesce("links", F.lit(0)).alias("links"))

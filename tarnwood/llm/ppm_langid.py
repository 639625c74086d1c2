"""Language identification by prediction by partial matching.

For each language a context tree of up to ``order`` bytes is counted on a bounded
sample of labelled documents and then frozen. A byte seen in its context has
probability n/(N+D), D being the number of distinct bytes seen there; the escape has
D/(N+D) and passes to the context one byte shorter, whose distribution is
renormalised over the bytes not seen in the longer one. The chain ends in the uniform
distribution over 256 byte values, so every context has a proper distribution and
-log2 of it is an exact code length.

Each language's tree is compiled into an automaton whose state is the longest
known context; each transition carries the code length. Texts are cut
into lanes that first reread ``order`` bytes, which restores the state exactly, and all
lanes step together in NumPy. A full pass is a narrow map: no shuffle. The size of a tree depends on its
language's sample only, so languages don't take contexts from one another, however many there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels

LANE = 256
LANES = 8192


@dataclass
class Tree:
    """The frozen automaton of one language. ``cost`` and ``step`` are by state * (symbols + 1) + symbol, cost in bits."""

    classes: np.ndarray
    symbols: int
    step: np.ndarray
    cost: np.ndarray


@dataclass
class Model:
    languages: list[str]
    order: int
    trees: list[Tree]
    #: bits a byte on held-out text of each language: its mean
    usual: np.ndarray

    def code_lengths(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Bits of each text under each language, and its bytes (of the lower-cased text)."""
        n = len(texts)
        bits, size = np.zeros((n, len(self.languages))), np.zeros(n, np.int64)
        for first, data, offsets in kernels.chunks(texts, lower=True):
            last = first + len(offsets) - 1
            bits[first:last] = self._chunk(data, offsets)
            size[first:last] = np.diff(offsets)
        return bits, size

    def _chunk(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        size = np.diff(offsets)
        per = -(-size // LANE)
        row = np.repeat(np.arange(len(size)), per)
        k = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
        begin = offsets[row] + k * LANE
        end = np.minimum(begin + LANE, offsets[row + 1])
        out = np.zeros((len(size), len(self.languages)))
        warm = self.order
        by_length = np.argsort(begin - end, kind="stable")  # lanes of one length together: little padding
        for at in range(0, len(row), LANES):
            own = by_length[at : at + LANES]
            longest = int((end[own] - begin[own]).max())
            where = np.arange(-warm, longest)[:, None] + begin[own][None, :]
            seen = data[np.clip(where, 0, len(data) - 1)].astype(np.int16)
            seen[(where < offsets[row[own]][None, :]) | (where >= end[own][None, :])] = 256
            for i, tree in enumerate(self.trees):
                width = np.int32(tree.symbols + 1)
                symbols = np.append(tree.classes, tree.symbols).astype(np.int32)[seen]  # 256: no byte
                state, total = np.zeros(len(own), np.int32), np.zeros(len(own), np.float32)
                for t in range(warm + longest):
                    move = state * width
                    move += symbols[t]
                    if t >= warm:
                        total += tree.cost.take(move)
                    state = tree.step.take(move)
                out[:, i] += np.bincount(row[own], total, len(size))
        return out


def _contexts(data: np.ndarray, offsets: np.ndarray, order: int, base: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each context length k up to order: distinct (context, symbol) codes and their counts."""
    at = np.arange(len(data))
    start = np.repeat(offsets[:-1], np.diff(offsets))
    code, found = data.astype(np.int64), []
    for k in range(order + 1):
        if k:
            code = code.copy()
            code[k:] += data[:-k].astype(np.int64) * base**k
        found.append(np.unique(code[at - start >= k], return_counts=True))
    return found


def train(samples: dict[str, list[str]], order: int = 4, trim: float = 0.2) -> Model:
    """Counts, freezes and compiles the trees.

    samples: texts by language. The ``trim`` share of each language's texts that a first
    tree codes worst (mislabelled or garbled) is left out of the second, which is
    returned. Every other text is held out once to learn what its language usually costs.
    """
    samples = {k: [t for t in v if t] for k, v in sorted(samples.items())}
    samples = {k: v for k, v in samples.items() if v} or {"und": ["a"]}
    trees, usual = [], []
    for texts in samples.values():
        cost_of = lambda tree, own: Model([""], order, [tree], np.ones(1)).code_lengths(pa.array(own))
        bits, size = cost_of(_compile(texts, order), texts)
        rank = np.argsort(bits[:, 0] / np.maximum(size, 1), kind="stable")
        kept = [texts[j] for j in sorted(rank[: max(1, math.ceil(len(texts) * (1 - trim)))])]
        bits, size = cost_of(_compile(kept[::2], order), kept[1::2] or kept)
        usual.append(bits.sum() / max(1, size.sum()))
        trees.append(_compile(kept, order))
    return Model(list(samples), order, trees, np.array(usual))


def _compile(texts: list[str], order: int) -> Tree:
    """The tree of one language: all contexts seen twice whose own prefix and suffix were."""
    parts = list(kernels.chunks(pa.array(texts), lower=True))
    data = np.concatenate([d for _, d, _ in parts])
    offsets = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(o) for _, _, o in parts]))])
    seen = np.unique(data)
    a = len(seen) + 1  # the last class: all bytes that the sample doesn't have; one probability each, and no context
    classes = np.full(256, len(seen), np.uint8)
    classes[seen] = np.arange(len(seen))
    unseen = max(1, 256 - len(seen))
    stats = _contexts(classes[data], offsets, order, a)

    known = [np.zeros(1, np.int64)]  # contexts of each length, as codes
    for k in range(1, order + 1):
        c, n = stats[k]
        context, which = np.unique(c // a, return_inverse=True)
        own = context[np.bincount(which, n) >= 2]
        # with its own prefix and suffix, as the automaton needs
        known.append(own[np.isin(own // a, known[k - 1]) & np.isin(own % a ** (k - 1), known[k - 1])])
    base = np.cumsum([0] + [len(x) for x in known])
    states = int(base[-1])

    cost = np.zeros((states, a + 1), np.float32)
    p = np.full((1, a), 1 / 256)
    for k in range(order + 1):
        ctx = known[k]
        if not len(ctx):
            break
        count = np.zeros((len(ctx), a))
        c, n = stats[k]
        where = np.searchsorted(ctx, c // a)
        hit = (where < len(ctx)) & (ctx[np.minimum(where, len(ctx) - 1)] == c // a)
        count[where[hit], c[hit] % a] = n[hit]
        below = p if k == 0 else p[np.searchsorted(known[k - 1], ctx % a ** (k - 1))]
        total, kinds = count.sum(1, keepdims=True), (count > 0).sum(1, keepdims=True)
        each = np.ones(a)
        each[-1] = unseen
        left = np.where(count > 0, 0, below * each).sum(1, keepdims=True)
        escape = np.where(left > 0, kinds / np.maximum(left, 1e-300), 0)
        p = np.where(total > 0, np.where(count > 0, count, below * escape) / np.maximum(total + kinds, 1), below)
        cost[base[k] : base[k + 1], :a] = -np.log2(np.maximum(p, 1e-30))

    step = np.zeros((states, a + 1), np.int32)
    symbol = np.arange(a)
    for k in range(order + 1):
        code = known[k][:, None] * a + symbol[None, :]  # the context and the byte after it
        to = np.full(code.shape, -1, np.int64)
        for m in range(min(k + 1, order), -1, -1):
            tail = code % a**m
            if m and len(known[m]):
                at = np.minimum(np.searchsorted(known[m], tail), len(known[m]) - 1)
                hit = (to < 0) & (known[m][at] == tail)
                to[hit] = base[m] + at[hit]
        step[base[k] : base[k + 1], :a] = np.maximum(to, 0)
    return Tree(classes, a, step.reshape(-1), cost.reshape(-1))


def training_rows(docs: DataFrame, per_language: int, max_chars: int) -> dict[str, list[str]]:
    """The bounded sample: per language the rows with the least hash of the id."""
    rows = docs.select(F.col("lang").cast("string").alias("l"), F.col("text").cast("string").alias("t"), F.xxhash64(F.col("doc_id").cast("string"), F.lit("ppm")).alias("h"))
    rows = rows.where("l is not null and length(t) between 100 and " + str(int(max_chars)))
    found: dict[str, list[str]] = {}
    best = rows.withColumn("n", F.row_number().over(Window.partitionBy("l").orderBy("h", "t"))).where(f"n <= {int(per_language)}")
    for r in best.select("l", "t", "n").orderBy("l", "n").collect():
        found.setdefault(r.l, []).append(r.t)
    return found


SCHEMA = "doc_id bigint, lang string, predicted string, bits double, bits_per_byte double, n_bytes bigint, accepted boolean"


def identify(
    docs: DataFrame, per_language: int = 160, max_chars: int = 6_000, order: int = 4, slack: float = 1.65, free_bits: float = 160.0, keep: bool = False, model: Model | None = None
) -> DataFrame:
    """Predicts the language of every document of ``docs(doc_id, text, lang)``.

    The prediction is the language with the least code length (the first by name on a
    tie). A document is accepted if that length is at most ``slack`` times the bits a byte
    that the language usually takes, plus ``free_bits``: text that no model can compress
    is no language. per_language rows of at most max_chars characters are the sample that
    the trees are counted on; nothing else is bounded. Of equal code lengths the first language by name is told.

    Null or empty text: predicted "und", zero bits, not accepted. Null id or declared
    language: carried through (rows without a declared language aren't trained on). Repeated
    rows: each is answered. Empty table: no rows. No labelled row at all: everything is
    judged against a trivial model and rejected. Other columns are ignored, or with keep
    returned: then the result is the accepted rows with the columns of ``docs``.
    """
    spark = docs.sparkSession
    model = model or train(training_rows(docs, per_language, max_chars), order)
    shared = spark.sparkContext.broadcast(model)  # its size follows per_language, max_chars and the number of languages, not the corpus
    names = docs.columns

    def judge(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        m = shared.value
        bits, size = m.code_lengths(texts)
        best = bits.argmin(1) if bits.size else np.zeros(len(size), int)
        least = bits[np.arange(len(size)), best]
        ok = (size > 0) & (least <= slack * m.usual[best] * size + free_bits)
        return [m.languages[b] if n else "und" for b, n in zip(best, size)], least, size, ok

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, least, size, ok = judge(b.column("text"))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("lang"), pa.array(lang, pa.string()), pa.array(least), pa.array(least / np.maximum(size, 1)), pa.array(size), pa.array(ok)],
                ["doc_id", "lang", "predicted", "bits", "bits_per_byte", "n_bytes", "accepted"],
            )

    def only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = judge(b.column(names.index("text")).cast(pa.string()))[3]
            yield b.filter(pa.array(ok))

    if keep:
        return docs.mapInArrow(only, T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema.fields]))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).mapInArrow(score, SCHEMA)

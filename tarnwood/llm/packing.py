"""Order-preserving packing of documents into token windows by dynamic programming.

The documents of a shard, in order, are a string of units (sentences; a unit longer than
the window is broken into pieces). A window takes consecutive units of at most ``window``
tokens; its cost is its padding plus a penalty for what its end cuts: nothing at the end
of a document, ``split_penalty`` between sentences of a document, ``truncate_penalty``
within a sentence. With T the running tokens, best[j] = window - T[j] + penalty[j] +
min(best[i] + T[i]) over the i with T[j] - T[i] <= window: a sliding-window minimum, kept
in a monotone queue, so that a shard takes linear time.

Shards are ``shard_docs`` documents each, neighbours in the order of ids, however the ids lie; windows don't cross
them. Ids alone are sorted, by range, to find where shards begin; texts are tokenised where they lie and then go to their
shard; only the counts by sentence are shuffled with them.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.staging import running_total
from . import kernels
from .common import text_hash

#: what the end of a unit is
DOCUMENT, SENTENCE, PIECE = 0, 1, 2
#: beginnings of shards that are broadcast, of 17 bytes each; with more shards than that, several share one and are told apart where they are packed
BEGINNINGS = 1_000_000
_STOP = np.zeros(256, bool)
_STOP[[ord("."), ord("!"), ord("?")]] = True


def units(texts: pa.Array, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The units of each text: row, tokens, end (in bytes of the text), kind of end.

    A token is a run of visible characters. A sentence ends after a token that ends in
    . ! or ?, or where a line ends. The last unit of a text ends the document, at its
    last byte.
    """
    parts = []
    for first, data, offsets in kernels.chunks(texts):
        starts, ends = kernels.runs(kernels.VISIBLE[data], offsets)
        if not len(starts):
            continue
        row = kernels.rows_of(starts, offsets)
        last = np.append(row[1:] != row[:-1], True)
        newline = np.concatenate([[0], np.cumsum(data == 10)])
        after = np.append(starts[1:], len(data))
        stop = _STOP[data[ends - 1]] | (newline[np.minimum(after, len(data))] > newline[ends])
        new_doc = np.append(True, last[:-1])
        # number of the token within its sentence, to break the long ones
        fresh = new_doc | np.append(True, stop[:-1])
        begin = np.maximum.accumulate(np.where(fresh, np.arange(len(row)), 0))
        number = np.arange(len(row)) - begin + 1
        kind = np.where(last, DOCUMENT, np.where(stop, SENTENCE, PIECE))
        cut = np.flatnonzero(last | stop | (number % window == 0))
        tokens = np.diff(np.append(-1, cut))
        end = np.where(last[cut], np.diff(offsets)[row[cut]], ends[cut] - offsets[row[cut]])
        parts.append((first + row[cut], tokens, end, kind[cut]))
    if not parts:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate([p[i] for p in parts]) for i in range(4))


def best_cuts(tokens: np.ndarray, penalty: np.ndarray, window: int) -> tuple[list[int], float]:
    """Ends (exclusive, in units) of the windows of least cost, and the cost.

    Among equal costs the longest last window wins. The end of the last window costs no
    penalty.
    """
    n = len(tokens)
    if not n:
        return [], 0.0
    total = np.concatenate([[0], np.cumsum(tokens)]).tolist()
    fine = penalty.tolist()
    fine[-1] = 0
    key, back = [0.0] * (n + 1), [0] * (n + 1)
    queue: deque[int] = deque([0])
    best = 0.0
    for j in range(1, n + 1):
        least = total[j] - window
        while total[queue[0]] < least:
            queue.popleft()
        i = queue[0]
        best = window - total[j] + fine[j - 1] + key[i]
        back[j] = i
        now = best + total[j]
        key[j] = now
        while queue and key[queue[-1]] > now:
            queue.pop()
        queue.append(j)
    cuts = []
    j = n
    while j:
        cuts.append(j)
        j = back[j]
    return cuts[::-1], best


class Beginnings:
    """Which of the ordered beginnings (doc_id, text_key), null ids last, a row belongs to."""

    def __init__(self, ids: list[int | None], keys: list[int]):
        self.named = sum(i is not None for i in ids)
        self.ids, self.keys = np.array(ids[: self.named], np.int64), np.array(keys, np.int64)

    def of(self, ids: pa.Array, keys: pa.Array) -> np.ndarray:
        null, key = ids.is_null().to_numpy(zero_copy_only=False), keys.to_numpy()
        doc = ids.fill_null(0).to_numpy()
        low, high = np.searchsorted(self.ids, doc, "left"), np.searchsorted(self.ids, doc, "right")
        low[null], high[null] = self.named, len(self.keys)
        first, last = low.copy(), low.copy()
        for a in np.unique(low[low < high]):  # ids that begin shards themselves
            w = np.flatnonzero((low == a) & (low < high))
            own = self.keys[a : high[w[0]]]
            first[w], last[w] = a + np.searchsorted(own, key[w], "left"), a + np.searchsorted(own, key[w], "right")
        # rows equal to several beginnings are equal to one another, and take turns
        many = np.maximum(last - first, 1)
        return np.maximum(last - 1 - np.arange(len(last)) % many, 0)


SCHEMA = "shard bigint, window bigint, n_tokens bigint, padding bigint, doc_ids array<bigint>, starts array<bigint>, ends array<bigint>"


def pack(docs: DataFrame, window: int = 2048, split_penalty: int = 64, truncate_penalty: int = 512, shard_docs: int = 1024, with_text: bool = False) -> DataFrame:
    """Packs docs(doc_id, text): (shard, window, n_tokens, padding, doc_ids, starts, ends).

    A row is a window; its k-th piece is the bytes starts[k]..ends[k] of the UTF-8 text of document
    doc_ids[k]. The pieces of a document, in order, are its whole text. with_text adds
    ``text``, the pieces joined by a blank line.

    Documents are in the order of (doc_id, hash of the text), null ids last. Documents without a token take no space and are left out. Repeated rows are
    packed each. Empty table: no rows.
    """
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keyed = slim.withColumn("text_key", text_hash(F.col("text")))
    ranked = running_total(keyed.select("doc_id", "text_key"), ["doc_id", "text_key"], name="rank")
    several = -(-ranked.count() // (shard_docs * BEGINNINGS)) or 1  # shards to a beginning
    found = ranked.where(F.col("rank") % (shard_docs * several) == 0).orderBy("rank").collect()  # BEGINNINGS at most
    begin = docs.sparkSession.sparkContext.broadcast(Beginnings([r.doc_id for r in found], [r.text_key for r in found]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, tokens, end, kind = units(b.column("text"), window)
            bound = np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(bound), pa.array(x.astype(t))) for x, t in ((tokens, np.int32), (end, np.int64), (kind, np.int8))]
            keep = [c for c in ("doc_id", "text_key", "text") if c != "text" or with_text]
            run = pa.array(begin.value.of(b.column("doc_id"), b.column("text_key")))
            out = pa.RecordBatch.from_arrays([run] + [b.column(c) for c in keep] + lists, ["run"] + keep + ["tokens", "ends", "kinds"])
            yield out.filter(pa.array(np.diff(bound) > 0))

    kinds = "tokens array<int>, ends array<bigint>, kinds array<tinyint>"
    counted = keyed.mapInArrow(scan, "run bigint, doc_id bigint, text_key bigint, " + ("text string, " if with_text else "") + kinds)

    def each(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["doc_id", "text_key"], na_position="last", kind="stable")
        cuts = range(0, len(own), shard_docs) if several > 1 else [0]
        return pd.concat([one(own.iloc[a : a + shard_docs] if several > 1 else own, own.run.iloc[0] * several + k) for k, a in enumerate(cuts)])

    def one(own: pd.DataFrame, shard: int) -> pd.DataFrame:
        sizes = own.tokens.map(len).to_numpy()
        tokens, ends, kind = (np.concatenate(own[c].to_list()) for c in ("tokens", "ends", "kinds"))
        fine = np.array([0, split_penalty, truncate_penalty])[kind]
        cuts, _ = best_cuts(tokens, fine, window)
        doc = np.repeat(np.arange(len(own)), sizes)
        total = np.concatenate([[0], np.cumsum(tokens)])
        ids = [None if pd.isna(x) else int(x) for x in own.doc_id]
        raw = [t.encode() for t in own.text] if with_text else None
        rows, at = [], 0
        for w, cut in enumerate(cuts):
            members, first = np.unique(doc[at:cut], return_index=True)
            last = np.append(first[1:], cut - at) - 1 + at
            first = first + at
            start = [int(ends[f - 1]) if f and doc[f - 1] == d else 0 for f, d in zip(first, members)]
            stop = [int(x) for x in ends[last]]
            n = int(total[cut] - total[at])
            row = [shard, w, n, window - n, [ids[d] for d in members], start, stop]
            if raw is not None:
                row.append("\n\n".join(raw[d][a:b].decode() for d, a, b in zip(members, start, stop)))
            rows.append(row)
            at = cut
        return pd.DataFrame(rows, columns=["shard", "window", "n_tokens", "padding", "doc_ids", "starts", "ends"] + ["text"] * with_text)

    return counted.groupBy("run").applyInPandas(each, SCHEMA + (", text string" if with_text else ""))

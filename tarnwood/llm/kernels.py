"""Vectorised byte kernels over Arrow string buffers.

Texts of an Arrow batch lie end to end in one buffer; these kernels walk it with
NumPy, so no text becomes a Python string.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that one call of a kernel gets; a longer text makes a chunk of its own.
CHUNK = 1 << 21
BASE = 0x100000001B3
INVERSE = pow(BASE, -1, 1 << 64)

_powers = {BASE: np.ones(1, np.uint64), INVERSE: np.ones(1, np.uint64)}


def powers(n: int, base: int = BASE) -> np.ndarray:
    """base**0 .. base**n modulo 2**64."""
    have = _powers[base]
    if len(have) <= n:
        have = np.full(max(n + 1, CHUNK + 1), base, np.uint64)
        have[0] = 1
        with np.errstate(over="ignore"):
            np.cumprod(have, out=have)
        _powers[base] = have
    return have[: n + 1]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads every bit over the word."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def spans_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the content of each data[start:end]; data: uint8 or uint64.

    Prefix sums of a polynomial; a span's share is moved to power zero with the
    inverse of the base, so the hash doesn't depend on the span's place.
    """
    n = len(data)
    with np.errstate(over="ignore"):
        terms = data.astype(np.uint64)
        terms += np.uint64(1)
        terms *= powers(n)[:n]
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(terms, out=total[1:])
        h = (total[ends] - total[starts]) * powers(n, INVERSE)[starts]
        return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def chunks(texts: pa.Array | pa.ChunkedArray, lower: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Cuts a string array into (first row, bytes, offsets of its rows in them); null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.utf8_lower(texts)
    if not len(texts):
        return
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offs, data = texts.buffers()
    at = np.frombuffer(offs, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(at, at[first] + CHUNK, "right")) - 1)
        last = min(last, len(texts))
        yield first, raw[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that stay within one row."""
    n = len(mask)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begin, stop = mask.copy(), mask.copy()
    begin[1:] &= ~mask[:-1] | edge[1:n]
    stop[:-1] &= ~mask[1:] | edge[1:n]
    return np.flatnonzero(begin), np.flatnonzero(stop) + 1


WORD = np.zeros(256, bool)
WORD[ord("0") : ord("9") + 1] = WORD[ord("a") : ord("z") + 1] = WORD[ord("A") : ord("Z") + 1] = WORD[128:] = True
WORD[ord("_")] = True
VISIBLE = np.ones(256, bool)
VISIBLE[[9, 10, 11, 12, 13, 32]] = False


def rows_of(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The row that holds each byte position."""
    counts = np.diff(np.searchsorted(starts, offsets, "left"))
    return np.repeat(np.arange(len(offsets) - 1), counts)

"""Line dedup by a suffix array over line-ID sequences.

A suffix is a (document, line) position and runs to the end of its document. It is ranked by its first
h lines, h = 1, 2, 4, ...: at first by the line id, then by the pair of its own rank and that of the suffix h
lines further on, the pairs being sorted by range and numbered by running totals, so that ranks order the suffixes as
a suffix array does and no task sees all of them. Suffixes of one rank at depth h are an interval of the suffix array whose longest common
prefix is h or more; those alone in theirs have found their place and leave.

A repeated run counts if it has ``min_chars`` visible characters. Every line of such a run, whatever its
length, lies in the least run with so many characters from some line on, or back from some line, so these least runs, which are the same
wherever their lines are, decide all. A run of L lines is named by the ranks at depth h of its first and of its last h
lines, h being the greatest power of two up to L; equal names are an interval of prefix L, and all but its first occurrence are later copies. Doubling ends at the longest of
the least runs; positions that no such run needs at a depth aren't ranked there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.staging import running_total
from . import kernels
from .common import rows_keyed, text_hash, written

_LINES = "doc_id bigint, text_key bigint, no_id boolean, pos int, id bigint, span int, single boolean, longer array<int>"


def _head() -> Column:
    """The first occurrence in a class."""
    return F.min(F.struct("no_id", "doc_id", "text_key", "pos")).alias("head")


def _is_later() -> Column:
    return ~(F.col("head.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("head.text_key") == F.col("text_key")) & (F.col("head.pos") == F.col("pos")))


def least_runs(data: np.ndarray, offsets: np.ndarray, min_chars: int) -> tuple[np.ndarray, ...]:
    """Of the lines of a chunk of texts: row, number in it, hash, lines from it that ranks are needed for, whether it is a least run by itself, and (line, length) of the longer ones."""
    breaks = np.flatnonzero(data == 10)
    filled = np.flatnonzero(np.diff(offsets) > 0)
    row = np.concatenate([np.arange(len(filled)), np.searchsorted(offsets[filled], breaks, "right") - 1])
    starts, ends = np.concatenate([offsets[filled], breaks + 1]), np.concatenate([offsets[filled + 1], breaks])
    starts, ends, row = starts[np.lexsort((starts, row))], ends[np.lexsort((ends, row))], np.sort(row)
    ids = kernels.spans_hash(data, starts, ends)
    seen = np.concatenate([[0], np.cumsum(kernels.VISIBLE[data] & ((data & 0xC0) != 0x80))])
    chars = seen[ends] - seen[starts]
    total = np.concatenate([[0], np.cumsum(chars)])
    n = np.arange(len(row))
    first = np.searchsorted(row, row, "left")
    last = np.searchsorted(row, row, "right")
    stop = np.searchsorted(total, total[:-1] + min_chars, "left")  # one past the end of the least run from each line on
    begin = np.searchsorted(total, total[1:] - min_chars, "right") - 1  # and its beginning back from each line
    stop = np.where(stop <= last, stop, 0)
    begin = np.where((begin >= first) & (total[1:] - total[first] >= min_chars), begin, -1)
    fwd, back = np.flatnonzero(stop > n + 1), np.flatnonzero((begin >= 0) & (begin < n))
    longer = np.unique(np.stack([np.concatenate([n[fwd], begin[back]]), np.concatenate([stop[fwd] - fwd, back - begin[back] + 1])], 1), axis=0)
    reach = n + 1
    np.maximum.at(reach, longer[:, 0], longer[:, 0] + longer[:, 1])
    reach = np.maximum.accumulate(reach) if len(reach) else reach
    within = (reach > n + 1) | (np.append(0, reach[:-1]) > n)[: len(n)]
    return filled[row], n - first, ids, np.where(within, reach - n, 0), chars >= min_chars, longer


def later_copies(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """(doc_id, text_key, pos, n): the least runs of n lines that occur earlier."""
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null and text <> ''")
    slim = slim.select("doc_id", "text", text_hash(F.col("text")).alias("text_key"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys = b.column("doc_id"), b.column("text_key")
            for first, data, offsets in kernels.chunks(b.column("text")):
                row, pos, line, span, single, longer = least_runs(data, offsets, max(1, min_chars))
                ends = np.searchsorted(longer[:, 0], np.arange(len(row) + 1)).astype(np.int32)
                take = pa.array(first + row)
                own = ids.take(take)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(longer[:, 1].astype(np.int32)))
                out = pa.RecordBatch.from_arrays([own, keys.take(take), own.is_null(), pa.array(pos.astype(np.int32)), pa.array(line.view(np.int64)), pa.array(span.astype(np.int32)), pa.array(single), lists], ["doc_id", "text_key", "no_id", "pos", "id", "span", "single", "longer"])
                yield out.filter(pa.array(single | (span > 0)))

    s = written(slim.mapInArrow(scan, _LINES), "lines")
    classes = s.groupBy("id").agg(F.count("*").alias("n"), _head()).where("n > 1").select(F.col("id").alias("i2"), "head")
    s = written(s.join(classes, F.col("id") == F.col("i2")).drop("i2"), "suffixes-1")
    found = [s.where(F.col("single") & _is_later()).select("doc_id", "text_key", "pos", F.lit(1).alias("n"))]
    runs = s.where(F.size("longer") > 0).select("doc_id", "text_key", "no_id", "pos", F.explode("longer").alias("n")).distinct()
    longest = runs.agg(F.max("n")).first()[0] or 1
    ranks = s.where("span > 0").select("doc_id", "text_key", "pos", F.col("id").alias("rank"), "span").distinct()  # repeated rows are one
    depth = 1
    while 2 * depth <= longest:
        ranks = _doubled(ranks, depth)
        depth *= 2
        found.append(_copies(runs.where(F.col("n").between(depth, 2 * depth - 1)), ranks, depth))
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


def _next(ranks: DataFrame, by: Column | int) -> DataFrame:
    return ranks.select(F.col("doc_id").alias("d2"), F.col("text_key").alias("t2"), (F.col("pos") - by).alias("p2"), F.col("rank").alias("rank2"))


def _same(pos: Column | None = None) -> Column:
    return F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("text_key") == F.col("t2")) & ((F.col("pos") if pos is None else pos) == F.col("p2"))


def _doubled(ranks: DataFrame, depth: int) -> DataFrame:
    """Ranks at twice the depth, of the suffixes whose class has another member and which some run needs."""
    pair = ranks.where(F.col("span") >= 2 * depth).join(_next(ranks, depth), _same()).drop("d2", "t2", "p2")
    pair = written(pair, f"pairs-{depth}")
    classes = pair.groupBy("rank", "rank2").agg(F.count("*").alias("n")).where("n > 1")
    numbered = running_total(classes, ["rank", "rank2"], "n", "place").select(F.col("rank").alias("a"), F.col("rank2").alias("b"), "place")
    again = pair.join(numbered, (F.col("rank") == F.col("a")) & (F.col("rank2") == F.col("b")))
    return written(again.select("doc_id", "text_key", "pos", F.col("place").alias("rank"), "span"), f"suffixes-{2 * depth}")


def _copies(runs: DataFrame, ranks: DataFrame, depth: int) -> DataFrame:
    """Of runs of depth to 2 * depth - 1 lines, those that occur earlier."""
    first = runs.join(_next(ranks, 0).withColumnRenamed("rank2", "r1"), _same()).drop("d2", "t2", "p2")
    both = first.join(_next(ranks, 0).withColumnRenamed("rank2", "r2"), _same(F.col("pos") + F.col("n") - depth))
    both = written(both.select("doc_id", "text_key", "no_id", "pos", "n", "r1", "r2"), f"runs-{depth}")
    classes = both.groupBy("n", "r1", "r2").agg(F.count("*").alias("m"), _head()).where("m > 1").select(F.col("n").alias("n2"), F.col("r1").alias("a"), F.col("r2").alias("b"), "head")
    return both.join(classes, (F.col("n") == F.col("n2")) & (F.col("r1") == F.col("a")) & (F.col("r2") == F.col("b"))).where(_is_later()).select("doc_id", "text_key", "pos", "n")


def repeated_runs(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """Runs of lines to delete: (doc_id, text_key, start_line, n_lines), lines counted from 0.

    A line goes if it lies in a run of lines, of any length, with ``min_chars`` visible characters
    in all, that occurs earlier, in the same document or in one that precedes it by
    (doc_id, hash of the text), null ids last. Neighbouring lines that go make one run. So every later copy of a line that isn't blank goes
    by default, and of blank lines those that the run has between or beside such lines.

    Null and empty texts have no lines. Repeated rows with one id and one text are one document: no line of them goes on
    account of the other. Empty table: no rows.
    """
    marks = later_copies(docs, min_chars).distinct().withColumn("end", F.col("pos") + F.col("n"))
    own = Window.partitionBy("doc_id", "text_key").orderBy("pos", "end")
    reach = F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1))
    island = marks.withColumn("new", F.when(reach.isNull() | (F.col("pos") > reach), 1).otherwise(0))
    island = island.withColumn("g", F.sum("new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy("doc_id", "text_key", "g").agg(F.min("pos").cast("bigint").alias("start_line"), (F.max("end") - F.min("pos")).cast("bigint").alias("n_lines")).drop("g")


def line_dedup(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """``docs`` with the later copies of repeated runs cut from its texts, all columns kept.

    A document that loses all its lines but blank ones goes; null and empty texts, and those without repeats, stay as they are, and
    so do both of two repeated rows of one id and one text. n_chars, where there is such a
    column, follows the text.
    """
    runs = repeated_runs(docs, min_chars).groupBy(F.col("doc_id").alias("rd"), F.col("text_key").alias("rk")).agg(F.array_sort(F.collect_list(F.struct("start_line", "n_lines"))).alias("runs"))
    both = rows_keyed(docs).join(runs, F.col("d").eqNullSafe(F.col("rd")) & (F.col("k") == F.col("rk")), "left")
    text = F.col("row")["text"].cast("string")
    # what lies between the runs, which are in order and apart
    number = F.size("runs")
    end = lambda i: F.when(i == 0, F.lit(0)).otherwise((F.get("runs", i - 1)["start_line"] + F.get("runs", i - 1)["n_lines"]).cast("int"))
    begin = lambda i: F.when(i == number, F.size("lines")).otherwise(F.get("runs", i)["start_line"].cast("int"))
    rest = F.flatten(F.transform(F.sequence(F.lit(0), number), lambda i: F.slice("lines", end(i) + 1, begin(i) - end(i))))
    cut = F.col("runs").isNotNull()
    both = both.withColumn("lines", F.when(cut, F.split(text, "\n", -1))).withColumn("kept", F.when(cut, F.array_join(rest, "\n")))
    both = both.where(~cut | F.col("kept").rlike(r"[^ \t\n\x0b\f\r]"))
    new = {"text": F.when(cut, F.col("kept")).otherwise(text), "n_chars": F.when(cut, F.char_length("kept").cast("bigint")).otherwise(F.col("row").getField("n_chars")) if "n_chars" in docs.columns else None}
    return both.select(*[(new[c] if c in new else F.col("row")[c]).alias(c) for c in docs.columns])

"""Lists of tokens in chunks with a dictionary each, so that a table about terms is joined to the dictionaries and not to every token."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .staging import staged, token_slices


@dataclass
class Chunks:
    """rows(doc_id, chunk, codes), a row a document; entries(chunk, code, value, doc_id, pos), each distinct token of a chunk and where it is first there, by doc_id and place."""

    rows: DataFrame
    entries: DataFrame


def chunked(tokens: DataFrame, column: str = "terms") -> Chunks:
    """tokens(doc_id, column) in chunks of about a million tokens, staged, so texts are split once. Null tokens are dropped."""
    key, value = tokens.schema["doc_id"].dataType, tokens.schema[column].dataType.elementType
    word = T.StructType([T.StructField("value", value), T.StructField("doc_id", key), T.StructField("pos", T.LongType())])
    schema = T.StructType([T.StructField("doc_id", key), T.StructField("chunk", T.LongType()), T.StructField("codes", T.ArrayType(T.IntegerType())), T.StructField("words", T.ArrayType(word))])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = TaskContext.get().partitionId() << 32
        for number, (ids, lists) in enumerate(token_slices(batches, column)):
            order = pc.sort_indices(ids)
            ids, lists = ids.take(order), lists.take(order)
            size, flat = np.diff(lists.offsets.to_numpy()), lists.flatten()
            row = np.repeat(np.arange(len(size)), size)
            if flat.null_count:
                row = row[flat.is_valid().to_numpy(zero_copy_only=False)]
                flat, size = flat.drop_null(), np.bincount(row, minlength=len(size))
            coded, ends = flat.dictionary_encode(), np.append(0, np.cumsum(size))
            codes = coded.indices.to_numpy()
            first = np.zeros(len(coded.dictionary), np.int64)
            first[codes[::-1]] = np.arange(len(codes))[::-1]
            words = pa.StructArray.from_arrays([coded.dictionary, ids.take(pa.array(row[first])), pa.array(first - ends[row[first]])], ["value", "doc_id", "pos"])
            # the chunk's first row has its dictionary
            at = pa.array(np.minimum(np.arange(len(size) + 1), 1) * len(words), pa.int32())
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(size), own + number)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), coded.indices), pa.ListArray.from_arrays(at, words)], schema.names)

    kept = staged(tokens.select("doc_id", column).mapInArrow(code, schema), "chunks")
    entries = kept.where(F.size("words") > 0).select("chunk", F.posexplode("words").alias("code", "w"))
    return Chunks(kept.select("doc_id", "chunk", "codes"), entries.select("chunk", "code", "w.value", "w.doc_id", "w.pos"))


def translated(chunks: Chunks, entries: DataFrame, name: str) -> DataFrame:
    """(doc_id, ``name``): each token replaced by ``out`` of entries(chunk, code, out), in order; tokens without one are dropped, documents aren't."""
    schema = T.StructType([chunks.rows.schema["doc_id"], T.StructField(name, T.ArrayType(entries.schema["out"].dataType))])

    def replace(docs: pa.Table, own: pa.Table) -> pa.Table:
        lists = docs["codes"].combine_chunks()
        lists = lists if isinstance(lists, pa.ListArray) else pa.concat_arrays(lists.chunks)
        codes, size, known = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy()), own["code"].to_numpy()
        place = np.full(max(codes.max(initial=-1), known.max(initial=-1)) + 1, -1, np.int64)
        place[known] = np.arange(len(known))
        at = place[codes]
        row = np.repeat(np.arange(len(size)), size)[at >= 0]
        out = own["out"].combine_chunks()
        values = (out if isinstance(out, pa.Array) else pa.concat_arrays(out.chunks)).take(pa.array(at[at >= 0]))
        ends = np.append(0, np.cumsum(np.bincount(row, minlength=len(size))))
        return pa.table([docs["doc_id"], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], names=schema.names)

    return chunks.rows.groupBy("chunk").cogroup(entries.select(F.col("chunk").alias("of"), "code", "out").groupBy("of")).applyInArrow(replace, schema)

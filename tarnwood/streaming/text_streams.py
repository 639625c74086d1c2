"""The same text expressions over streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.params import RankParams
from ..functions.text import tokenize
from ..operators.index import Index, document_lengths, index_terms, term_rows
from ..operators.retrieve import analyse_queries, retrieve
from ..operators.staging import fresh_path


def read_documents(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A stream of the Parquet files that come into a folder (or of the file itself)."""
    schema = schema or spark.read.parquet(path).schema
    import os

    folder, name = os.path.split(path.rstrip("/"))
    if name.endswith(".parquet") and os.path.isfile(path):
        return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    return spark.readStream.schema(schema).parquet(path)


def stream_tokens(docs: DataFrame, **analysis: object) -> DataFrame:
    """(doc_id, terms) of an unbounded source; stateless."""
    return tokenize(docs, **analysis)


def stream_term_counts(docs: DataFrame, **analysis: object) -> DataFrame:
    """(term, df, tf): documents that hold a term, and its occurrences, so far.

    A document arrives once and in one row, so its terms are counted within the row and the
    only state is a row a term.
    """
    return term_rows(tokenize(docs, **analysis)).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


def windowed_counts(events: DataFrame, time_col: str, key_col: str, window: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(start, end, key, n): counts by event-time window; rows later than the watermark are dropped."""
    w = F.window(time_col, window, slide) if slide else F.window(time_col, window)
    # Parquet may bring timestamps without a zone, which can't be event times: they are read in the session's
    events = events.withColumn(time_col, F.col(time_col).cast("timestamp"))
    counted = events.withWatermark(time_col, late).groupBy(w.alias("w"), F.col(key_col).alias("key")).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "key", "n")


def ingest(docs: DataFrame, path: str, checkpoint: str, **analysis: object) -> StreamingQuery:
    """Appends the postings (term, doc_id, tf, dl) and lengths of arriving documents under ``path``.

    Scores depend on the whole corpus and are derived when the index is opened. A batch is
    written to a folder of its own number, so that a repeated batch replaces itself.
    """

    def append(batch: DataFrame, number: int) -> None:
        tokens = tokenize(batch, **analysis)
        term_rows(tokens).write.mode("overwrite").parquet(f"{path}/tf/batch={number}")
        document_lengths(tokens).write.mode("overwrite").parquet(f"{path}/docs/batch={number}")

    return docs.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def open_ingested(spark: SparkSession, path: str, params: RankParams | None = None, **analysis: object) -> Index:
    """The index of all that :func:`ingest` has written."""
    return index_terms(spark.read.parquet(f"{path}/tf").drop("batch"), spark.read.parquet(f"{path}/docs").drop("batch"), params or RankParams(), analysis)


def answer(index: Index, queries: DataFrame, sink: Callable[[DataFrame, int], None], k: int = 10, checkpoint: str | None = None) -> StreamingQuery:
    """Answers a stream of queries(query_id, text) against an index, batch by batch."""

    def run(batch: DataFrame, number: int) -> None:
        sink(retrieve(index, analyse_queries(index, batch), k, check=False), number)

    out = queries.writeStream.foreachBatch(run).trigger(availableNow=True)
    return (out.option("checkpointLocation", checkpoint) if checkpoint else out).start()


def drain(stream: DataFrame, what: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now and returns its result, a table in the shared folder.

    In "append" mode each batch adds its rows; in "complete" mode the last replaces all.
    """
    spark, at = stream.sparkSession, fresh_path(stream.sparkSession, what)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(at if mode == "complete" else f"{at}/batch={number}")

    query = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{at}-progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(at)

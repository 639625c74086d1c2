"""Scoring batches of queries against an index.

The batch's distinct terms are numbered and staged; the index is narrowed to them, and an index
that isn't saved stages what is left, from which document frequencies, scores and results are computed.
Up to ``TERM_LIMIT`` terms are pushed into the scan of a saved index as bucket and term filters. The narrowed
postings are shuffled once, by document, into tasks of about ``PAIRS`` pairs of query and document; there
they meet a broadcast block of up to ``ROW_LIMIT`` rows (query, term), the scores of a pair are summed and all but k rows of each
query are dropped, so that no pair is shuffled. Larger batches go block by block. Where there are many tasks, a share of the documents is
ranked first: its k-th score bounds that of all, and what is less isn't sorted or shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import idf_weight, rounded, tf_absent
from ..functions.text import tokenize
from .index import Index, bucket_of, load_index, scored
from .staging import fresh_path, running_total, staged

TERM_LIMIT = 20_000
#: rows (query, term) of a block, and terms, that are broadcast
ROW_LIMIT = 500_000
#: pairs of query and document that a task scores
PAIRS = 500_000
#: tasks from which on the scores of one document in ``SHARE`` bound those of all
TASKS, SHARE = 32, 20
#: blocks whose results are computed in one job
BLOCKS = 8
#: scores are rounded so that equal ones tie whatever the order of their summation
DIGITS = 9


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, qtf) of queries(query_id, terms); repeats count."""
    return queries.select("query_id", F.explode(F.col("terms").cast("array<string>")).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def analyse_queries(index: Index, queries: DataFrame, text_col: str = "text", id_col: str = "query_id") -> DataFrame:
    """(query_id, terms), analysed as the index was."""
    return tokenize(queries, text_col, id_col, **{k: v for k, v in index.analysis.items() if k != "empty"}).withColumnRenamed("doc_id", "query_id")


@dataclass
class Batch:
    """A batch of queries and what an index holds of its terms."""

    #: (query_id, t, qtf), t numbering the terms, and its rows
    asked: DataFrame
    rows: int
    #: (t, doc_id, score) of these terms
    postings: DataFrame
    #: (query_id, const): what a document without any of the terms scores, unknown terms adding nothing; None if that is 0
    const: DataFrame | None


def _broadcast(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= ROW_LIMIT else df


def narrowed(index: Index, qtf: DataFrame) -> Batch:
    """The batch's own part of the index."""
    terms = staged(qtf.select("term").distinct().withColumn("t", F.monotonically_increasing_id()), "asked-terms")
    n_terms = terms.count()
    asked = staged(qtf.join(terms, "term").select("query_id", "t", "qtf"), "asked")
    rows = asked.count()
    own = index.postings if index.tf is None else index.tf
    if "term_bucket" in own.columns and n_terms <= TERM_LIMIT:
        words = terms.withColumn("b", bucket_of(F.col("term"), index.buckets)).collect()
        own = own.where(F.col("term_bucket").isin(sorted({w.b for w in words})) & F.col("term").isin([w.term for w in words]))
    own = own.join(_broadcast(terms, n_terms), "term")
    if index.tf is None or index.counted:
        vocab = index.vocab.join(_broadcast(terms, n_terms), "term").select("t", "idf", "nonocc")
    else:
        own = staged(own.select("t", "doc_id", "tf", "dl"), "asked-tf")
        idf = idf_weight(index.params.idf, F.col("df").cast("double"), F.col("n_docs").cast("double"))
        df = own.groupBy("t").agg(F.count("*").alias("df")).crossJoin(F.broadcast(index.fixed().select("n_docs")))
        vocab = df.select("t", idf.alias("idf"), (idf * F.lit(float(tf_absent(index.params)))).alias("nonocc"))
    const = None
    if index.params.shifted:
        const = asked.join(_broadcast(vocab, n_terms), "t").groupBy("query_id").agg(F.sum(F.col("nonocc") * F.col("qtf")).alias("const"))
    if index.tf is not None:
        own = scored(own.select("t", "doc_id", "tf", "dl").join(_broadcast(vocab, n_terms), "t"), index.fixed(), index.params)
    return Batch(asked, rows, own.select("t", "doc_id", "score"), const)


def _by_block(index: Index, batch: Batch, queries: int, mask: DataFrame | None, then: Callable[[DataFrame], DataFrame], every: DataFrame | None = None) -> DataFrame:
    """``then`` of (query_id, doc_id, score[, weight]), the summed scores without constants, for each block of queries, all in tasks by doc_id.

    every(query_id): the queries for which documents without any term come too, with 0.
    """
    blocks = max(1, -(-batch.rows // ROW_LIMIT))
    postings, asked = batch.postings, batch.asked
    if every is not None:  # -1 is a term of all, for the documents without any other
        postings = postings.unionByName(index.docs.select(F.lit(-1).cast("bigint").alias("t"), "doc_id", F.lit(0.0).alias("score")))
        asked = asked.unionByName(every.select("query_id", F.lit(-1).cast("bigint").alias("t"), F.lit(0).cast("bigint").alias("qtf")))
    tasks = max(1, -(-index.n_docs * -(-queries // blocks) // PAIRS))
    postings = postings.repartition(tasks, "doc_id")
    sums, by = [F.sum(F.col("score") * F.col("qtf")).alias("score")], ["query_id", "doc_id"]
    if mask is not None:
        postings = postings.join(mask.select("doc_id", F.col("weight").cast("double").alias("weight")), "doc_id", "left")
        sums.append(F.max("weight").alias("weight"))
    asked = asked.withColumn("block_", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    parts = [then(postings.join(F.broadcast(asked.where(F.col("block_") == b).drop("block_")), "t").groupBy(*by).agg(*sums)) for b in range(blocks)]
    if blocks <= BLOCKS:
        return reduce(DataFrame.unionByName, parts)
    at = fresh_path(index.docs.sparkSession, "blocks")
    for b in range(0, blocks, BLOCKS):
        reduce(DataFrame.unionByName, parts[b : b + BLOCKS]).write.mode("append").parquet(at)
    return index.docs.sparkSession.read.schema(parts[0].schema).parquet(at)


def hits(index: Index, qtf: DataFrame) -> DataFrame:
    """(query_id, doc_id, score): the summed scores of documents with some term of the query, without constants."""
    return _by_block(index, narrowed(index, qtf), qtf.select("query_id").distinct().count(), None, lambda df: df)


def _weighted(scored: DataFrame, const: DataFrame | None, mask: DataFrame | None, mask_mode: str) -> DataFrame:
    """Applies mask and constant to (query_id, doc_id, score, ...), which may have the mask's weight already."""
    if const is not None:
        scored = scored.join(F.broadcast(const), "query_id", "left")
    c = F.coalesce(F.col("const"), F.lit(0.0)) if const is not None else F.lit(0.0)
    w = F.lit(1.0)
    if mask is not None:
        if "weight" not in scored.columns:
            scored = scored.join(mask.select("doc_id", F.col("weight").cast("double").alias("weight")), "doc_id", "left")
        w = F.coalesce(F.col("weight"), F.lit(1.0))
    total = (F.col("score") + c) * w if mask_mode == "post" else F.col("score") * w + c
    return scored.withColumn("total", rounded(total, DIGITS)).withColumn("part", rounded(F.col("score") * w, DIGITS))


def check_mask(index: Index, mask: DataFrame) -> None:
    """A mask names documents of the index, each once."""
    if "doc_id" not in mask.columns or "weight" not in mask.columns:
        raise ValueError("a mask needs the columns doc_id and weight")
    if not mask.groupBy("doc_id").count().where("count > 1").isEmpty():
        raise ValueError("a mask may weigh a document once only")
    if not mask.join(index.docs, "doc_id", "left_anti").isEmpty():
        raise ValueError("the mask has documents that the index lacks")


def check_ids(index: Index, queries: DataFrame) -> None:
    """Queries of term ids, not strings, stay within the ids of the vocabulary."""
    if dict(queries.dtypes)["terms"] == "array<string>":
        return
    asked = queries.select(F.explode(F.col("terms").cast("array<bigint>")).alias("t")).agg(F.min("t").alias("a"), F.max("t").alias("b")).first()
    most = index.vocab.agg(F.max(F.expr("try_cast(term AS BIGINT)"))).first()[0]
    if asked.a is not None and (asked.a < 0 or most is None or asked.b > most):
        raise ValueError(f"query ids lie between {asked.a} and {asked.b}; those of the index end at {most}")


def score_all(index: Index, queries: DataFrame, mask: DataFrame | None = None, mask_mode: str = "pre") -> DataFrame:
    """(query_id, doc_id, score) for every pair: the dense result. It grows with queries times documents."""
    batch, every = narrowed(index, query_terms(queries)), queries.select("query_id").distinct()
    out = _by_block(index, batch, every.count(), mask, lambda df: _weighted(df, batch.const, mask, mask_mode).select("query_id", "doc_id", F.col("total").alias("score")), every)
    return out.withColumn("score", F.col("score").cast("float")) if index.params.dtype == "float32" else out


def retrieve(index: Index, queries: DataFrame, k: int = 10, mask: DataFrame | None = None, mask_mode: str = "pre", fill: bool = True, payload: bool = False, check: bool = True, sorted: bool = True) -> DataFrame:
    """The k best documents of each query: (query_id, rank, doc_id, score), and the payload.

    queries(query_id, terms). Ties go to the lesser doc_id. With fill, documents that score
    no more than the constant fill a query up to k. mask(doc_id, weight) multiplies scores:
    "pre" before the constant of the shifted methods is added, "post" after; documents it doesn't name weigh 1.
    check: ask the index whether k exceeds its documents, whether the mask is sound (:func:`check_mask`) and whether term ids
    are in its range (:func:`check_ids`). Without it, a mask must name a document once and weigh none below zero.
    sorted: with False the k best come without ranks, for those who need the set only.
    """
    if k < 0:
        raise ValueError("k must not be negative")
    if mask_mode not in ("pre", "post"):
        raise ValueError(f"unknown mask_mode {mask_mode!r}")
    if check and k > index.n_docs:
        raise ValueError(f"k = {k} exceeds the {index.n_docs} documents of the index")
    if check:
        check_ids(index, queries)
        if mask is not None:
            check_mask(index, mask)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    if mask is not None and fill and check and not mask.where("weight < 0").isEmpty():
        # below zero a hit ranks after documents without any term, so that all must be ranked
        scored = score_all(index, queries, mask, mask_mode)
    else:
        batch, every = narrowed(index, query_terms(queries)), queries.select("query_id").distinct()

        def top(pairs: DataFrame, least: DataFrame | None = None) -> DataFrame:
            own = _weighted(pairs, batch.const, mask, mask_mode)
            own = (own.where("part <> 0") if fill else own).select("query_id", "doc_id", F.col("total").alias("score"))
            if least is not None:
                own = own.join(F.broadcast(least), "query_id", "left").where("least is null or score >= least").drop("least")
            return own.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank")

        n, least = every.count(), None
        if k and index.n_docs * n > TASKS * PAIRS:
            some = replace(batch, postings=batch.postings.where(F.pmod(F.xxhash64("doc_id"), F.lit(SHARE)) == 0))
            least = _by_block(index, some, -(-n // SHARE), mask, top).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least"))
            least = staged(least.where(F.col("n") >= k).drop("n"), "least")
        scored = _by_block(index, batch, n, mask, lambda pairs: top(pairs, least))
        if fill:
            # h hits displace h fillers at most, so the first k documents are enough
            order = [F.col("doc_id")]
            pool = index.docs.select("doc_id")
            if mask is not None and mask_mode == "post" and index.params.shifted:
                pool = pool.join(mask.select("doc_id", "weight"), "doc_id", "left").select("doc_id", F.coalesce(F.col("weight").cast("double"), F.lit(1.0)).alias("w"))
                order = [F.col("w").desc(), F.col("doc_id")]
            first = pool.orderBy(*order).limit(k).select("doc_id")
            fillers = every.crossJoin(F.broadcast(first)).withColumn("score", F.lit(0.0))
            fillers = _weighted(fillers, batch.const, mask, mask_mode).select("query_id", "doc_id", F.col("total").alias("score"), F.lit(0).alias("own"))
            # a filler that is among the hits gives way to its own score
            scored = scored.withColumn("own", F.lit(1)).unionByName(fillers).groupBy("query_id", "doc_id").agg(F.max_by("score", "own").alias("score"))
    ranked = scored.withColumn("rank", F.row_number().over(best).cast("bigint")).where(F.col("rank") <= k)
    if index.params.dtype == "float32":
        ranked = ranked.withColumn("score", F.col("score").cast("float"))
    out = ranked.select("query_id", *(["rank"] if sorted else []), "doc_id", "score")
    return with_payload(out, index) if payload else out


def with_payload(results: DataFrame, index: Index) -> DataFrame:
    """Results joined to the documents' own columns."""
    return results.join(index.docs.drop("dl"), "doc_id")


def retrieve_batches(path: str, queries: DataFrame, out: str, k: int = 10, size: int = 100_000, **options: object) -> DataFrame:
    """:func:`retrieve` for ``size`` queries at a time against the index saved at ``path``, opened anew for each batch, so that nothing of one batch stays for the next.

    Results are added to the Parquet folder ``out``, which is read and returned.
    """
    spark = queries.sparkSession
    numbered = running_total(queries, ["query_id"], name="turn")
    for b in range(-(-numbered.count() // size)):
        own = numbered.where((F.col("turn") >= b * size) & (F.col("turn") < (b + 1) * size)).drop("turn")
        retrieve(load_index(spark, path), own, k, **options).write.mode("append").parquet(out)
    return spark.read.parquet(out)


def merge_results(parts: list[DataFrame]) -> DataFrame:
    """Results of several batches end to end; query ids must be distinct already."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def to_matrix(results: DataFrame) -> tuple[list[list], list[list[float]]]:
    """(doc ids, scores) by query, as lists in the order of query_id and rank. For small results."""
    rows = results.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "doc_id", "score"))).alias("r")).orderBy("query_id").collect()
    return [[x.doc_id for x in r.r] for r in rows], [[x.score for x in r.r] for r in rows]

"""Building, keeping and refreshing an inverted index as DataFrames.

Tables: postings(term, doc_id, tf, dl, score), one row for each term of each document, with the
document's length and the score it contributes; vocab(term, df, idf, nonocc); docs(doc_id, dl, payload). Scores
are computed once, at build time; tf stays beside them, so that another formula or a grown
corpus needs no tokenising. On disk, postings are clustered by a hash bucket of the term
and sorted by (term, doc_id), so that a query reads the buckets and row groups of its terms.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import __version__
from ..functions.params import RankParams
from ..functions.scoring import idf_weight, tf_absent, tf_weight
from ..functions.text import DEFAULT_PATTERN, drop_stopwords, fill_empty, split_terms, tokenize
from .staging import running_total, staged, token_slices

#: buckets of the postings at least, and postings that a bucket is meant to hold
BUCKETS, BUCKET_ROWS = 64, 1_000_000


def term_frequencies(tokens: DataFrame) -> DataFrame:
    """(term, doc_id, tf). Tokens of a document lie in one row, so the partial aggregate has done the counting before the shuffle."""
    return tokens.select("doc_id", F.explode("terms").alias("term")).groupBy("term", "doc_id").agg(F.count("*").alias("tf"))


def term_rows(tokens: DataFrame) -> DataFrame:
    """(term, doc_id, tf, dl): each row counted in itself, so nothing is shuffled. doc_id is a key; dl is the row's number of tokens."""
    schema = T.StructType([T.StructField("term", T.StringType()), tokens.schema["doc_id"], T.StructField("tf", T.LongType()), T.StructField("dl", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, lists in token_slices(batches, "terms"):
            size = np.diff(lists.offsets.to_numpy())
            flat, row = lists.flatten(), np.repeat(np.arange(len(size)), size)
            if flat.null_count:
                row = row[flat.is_valid().to_numpy(zero_copy_only=False)]
                flat = flat.drop_null()
            coded = flat.dictionary_encode()
            words = max(1, len(coded.dictionary))
            key, times = np.unique(row * words + coded.indices.to_numpy(), return_counts=True)
            row = key // words
            yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(key % words)), ids.take(pa.array(row)), pa.array(times.astype(np.int64)), pa.array(size[row].astype(np.int64))], schema.names)

    return tokens.select("doc_id", "terms").mapInArrow(count, schema)


def with_lengths(tf: DataFrame, docs: DataFrame) -> DataFrame:
    """tf with dl, which tables of earlier versions lack."""
    return tf if "dl" in tf.columns else tf.join(docs.select("doc_id", "dl"), "doc_id")


def document_lengths(tokens: DataFrame) -> DataFrame:
    return tokens.select("doc_id", F.size("terms").cast("bigint").alias("dl"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row: n_docs, avgdl (0 for an empty corpus), n_tokens. Empty documents count."""
    return lengths.agg(F.count("*").alias("n_docs"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"), F.coalesce(F.sum("dl"), F.lit(0)).alias("n_tokens"))


def document_frequencies(tf: DataFrame) -> DataFrame:
    return tf.groupBy("term").agg(F.count("*").alias("df"))


def vocabulary(df: DataFrame, stats: DataFrame, p: RankParams) -> DataFrame:
    """(term, df, idf, nonocc)."""
    d, n = F.col("df").cast("double"), F.col("n_docs").cast("double")
    idf = idf_weight(p.idf, d, n)
    return df.crossJoin(F.broadcast(stats.select("n_docs"))).select("term", "df", idf.alias("idf"), (idf * F.lit(float(tf_absent(p)))).alias("nonocc"))


def scored(rows: DataFrame, stats: DataFrame, p: RankParams) -> DataFrame:
    """rows(term or its number, doc_id, tf, dl, idf, nonocc) with score: idf * tf weight, less nonocc for the shifted methods."""
    weight = tf_weight(p, F.col("tf").cast("double"), F.col("dl").cast("double"), F.col("avgdl"))
    score = F.col("idf") * weight - F.col("nonocc") if p.shifted else F.col("idf") * weight
    joined = rows.where("doc_id is not null").crossJoin(F.broadcast(stats.select("avgdl")))
    return joined.withColumn("score", score).drop("avgdl", "idf", "nonocc")


def score_postings(tf: DataFrame, stats: DataFrame, p: RankParams) -> DataFrame:
    """(term, doc_id, tf, dl, score). Documents of a term are counted where its rows lie, in the one shuffle."""
    whole = Window.partitionBy("term")
    d, n = F.col("df_").cast("double"), F.col("n_docs").cast("double")
    rows = tf.withColumn("df_", F.count("*").over(whole)).crossJoin(F.broadcast(stats.select("n_docs"))).withColumn("idf", idf_weight(p.idf, d, n))
    return scored(rows.withColumn("nonocc", F.col("idf") * F.lit(float(tf_absent(p)))).drop("df_", "n_docs"), stats, p)


def bucket_of(term: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


@dataclass
class Index:
    """An index: lazy tables and its parameters. stats is the one-row DataFrame of :func:`corpus_stats`."""

    params: RankParams
    docs: DataFrame
    postings: DataFrame
    vocab: DataFrame
    stats: DataFrame
    analysis: dict
    buckets: int | None = None
    #: (term, doc_id, tf, dl), where postings are still to be computed from it
    tf: DataFrame | None = None
    #: whether vocab is a table, whose df hold for tf
    counted: bool = False
    row: Row | None = None

    def fixed(self) -> DataFrame:
        """stats as a row of the plan, computed once."""
        self.row = self.row or self.stats.first()
        return self.docs.sparkSession.createDataFrame([tuple(self.row)], self.stats.schema)

    @property
    def n_docs(self) -> int:
        self.row = self.row or self.stats.first()
        return self.row["n_docs"]

    def describe(self) -> DataFrame:
        """n_docs, n_terms, n_postings, postings_per_doc, avgdl."""
        terms = self.vocab.agg(F.count("*").alias("n_terms"), F.coalesce(F.sum("df"), F.lit(0)).alias("n_postings"))
        per = F.when(F.col("n_docs") > 0, F.col("n_postings") / F.col("n_docs")).otherwise(F.lit(0.0))
        return self.stats.crossJoin(terms).select("n_docs", "n_terms", "n_postings", per.alias("postings_per_doc"), "avgdl")

    def rescore(self, params: RankParams) -> Index:
        """The same postings under other parameters."""
        counted = self.tf is None or self.counted
        tf = with_lengths(self.postings.drop("score"), self.docs) if self.tf is None else self.tf
        vocab = vocabulary(self.vocab.select("term", "df"), self.stats, params)
        plain = tf.select("term", "doc_id", "tf", "dl")
        postings = scored(plain.join(vocab.select("term", "idf", "nonocc"), "term"), self.stats, params) if counted else score_postings(plain, self.stats, params)
        return replace(self, params=params, vocab=vocab, postings=postings, tf=tf, counted=counted)

    def append(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
        """With more documents: frequencies and lengths change, so all scores are derived anew from tf. Ids that the index has raise ValueError."""
        if not docs.select(F.col(id_col).alias("doc_id")).join(self.docs.select("doc_id"), "doc_id", "left_semi").isEmpty():
            raise ValueError("documents to be added have ids that the index holds")
        tokens = tokenize(docs, text_col, id_col, **self.analysis)
        tf = with_lengths(self.postings if self.tf is None else self.tf, self.docs).select("term", "doc_id", "tf", "dl").unionByName(term_rows(tokens))
        return index_terms(tf, self.docs.unionByName(_sized(docs, tokens, text_col, id_col, self.analysis), allowMissingColumns=True), self.params, self.analysis)

    def offsets(self) -> DataFrame:
        """(term, start, stop): where each term's postings lie if they are laid end to end by term, for export."""
        begin = running_total(self.vocab.select("term", "df"), ["term"], "df", "start")
        return begin.select("term", "start", (F.col("start") + F.col("df")).alias("stop"))

    def save(self, path: str) -> None:
        """Writes postings, vocab, docs and params; overwrites.

        Texts are tokenised for the documents' column dl and for the frequencies, which are staged; all else is computed from
        these. Postings are shuffled once, by bucket; there are as many buckets as they need. ``path`` must not be where this index was loaded from.
        """
        spark = self.docs.sparkSession
        self.docs.write.mode("overwrite").parquet(f"{path}/docs")
        if self.tf is not None:
            tf = staged(self.tf.select("term", "doc_id", "tf", "dl"), "tf")
            row = corpus_stats(spark.read.schema(self.docs.schema).parquet(f"{path}/docs")).first()
        else:
            tf, row = self.postings.drop("term_bucket"), self.stats.first()
        stats = spark.createDataFrame([tuple(row)], self.stats.schema)
        vocab = vocabulary(document_frequencies(tf), stats, self.params) if self.tf is not None else self.vocab
        vocab.sort("term").write.mode("overwrite").parquet(f"{path}/vocab")
        buckets = max(BUCKETS, -(-tf.count() // BUCKET_ROWS))
        placed = lambda df: df.withColumn("term_bucket", bucket_of(F.col("term"), buckets)).repartition(buckets, "term_bucket")
        clustered = placed(tf).sortWithinPartitions("term_bucket", "term", "doc_id")
        if self.tf is not None:  # the join keeps the order
            known = placed(spark.read.schema(vocab.schema).parquet(f"{path}/vocab").select("term", "idf", "nonocc"))
            clustered = scored(clustered.join(known, ["term_bucket", "term"]), stats, self.params)
        clustered.write.mode("overwrite").partitionBy("term_bucket").parquet(f"{path}/postings")
        meta = {"version": __version__, "params": self.params.to_dict(), "analysis": self.analysis, "buckets": buckets} | row.asDict()
        self.docs.sparkSession.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/params")


def load_index(spark: SparkSession, path: str, **overrides: object) -> Index:
    """Opens a saved index lazily. overrides replace parameters; scores are then derived anew."""
    meta = json.loads(spark.read.text(f"{path}/params").first()["value"])
    stats = spark.createDataFrame([(meta["n_docs"], meta["avgdl"], meta["n_tokens"])], "n_docs bigint, avgdl double, n_tokens bigint")
    index = Index(RankParams(**meta["params"]), spark.read.parquet(f"{path}/docs"), spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/vocab"), stats, meta["analysis"], meta["buckets"])
    return index.rescore(replace(index.params, **overrides)) if overrides else index


def index_terms(tf: DataFrame, docs: DataFrame, params: RankParams, analysis: dict | None = None, terms: DataFrame | None = None) -> Index:
    """An index from tf(term, doc_id, tf, dl) and docs(doc_id, dl, payload). terms: the same terms as tf, where they come cheaper."""
    stats, tf = corpus_stats(docs), with_lengths(tf, docs)
    vocab = vocabulary(document_frequencies(tf if terms is None else terms), stats, params)
    return Index(params, docs, score_postings(tf, stats, params), vocab, stats, analysis or {}, tf=tf)


def _sized(docs: DataFrame, tokens: DataFrame, text_col: str, id_col: str, analysis: dict) -> DataFrame:
    """docs with dl."""
    sized = docs.withColumnRenamed(id_col, "doc_id")
    if "stemmer" in analysis:
        return sized.join(document_lengths(tokens), "doc_id", "left").withColumn("dl", F.coalesce("dl", F.lit(0)))
    # the length is an expression of the row: no join
    terms = drop_stopwords(split_terms(F.col(text_col), analysis.get("pattern", DEFAULT_PATTERN), analysis.get("lower", True)), analysis.get("stopwords"))
    return sized.withColumn("dl", F.size(fill_empty(terms, analysis.get("empty", "keep_empty"))).cast("bigint"))


def _distinct_terms(tokens: DataFrame) -> DataFrame:
    """(term), once for each document; explode_outer, as explode would have the texts split again to drop the empty ones."""
    return tokens.select(F.explode_outer(F.array_distinct("terms")).alias("term")).where("term is not null")


def build_index(docs: DataFrame, params: RankParams | None = None, id_col: str = "doc_id", text_col: str = "text", payload: bool = True, **analysis: object) -> Index:
    """Indexes docs. analysis: the options of :func:`tarnwood.functions.text.tokenize`."""
    tokens = tokenize(docs, text_col, id_col, **analysis)
    kept = _sized(docs, tokens, text_col, id_col, analysis)
    return index_terms(term_rows(tokens), kept if payload else kept.select("doc_id", "dl"), params or RankParams(), analysis, _distinct_terms(tokens))


def build_index_from_terms(tokens: DataFrame, params: RankParams | None = None) -> Index:
    """Indexes tokens(doc_id, terms array of strings or ids); ids needn't be dense."""
    kind = dict(tokens.dtypes)["terms"]
    if not kind.startswith("array"):
        raise ValueError(f"terms must be an array column, not {kind}; raw text needs build_index")
    if kind != "array<string>":
        tokens = tokens.withColumn("terms", F.col("terms").cast("array<string>"))
    return index_terms(term_rows(tokens), document_lengths(tokens), params or RankParams(), terms=_distinct_terms(tokens))

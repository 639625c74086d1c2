"""Vocabularies: terms to ids and back."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import DEFAULT_PATTERN, drop_stopwords, split_terms, stem_lexicon
from .chunks import Chunks, chunked, translated
from .staging import running_total


def _chunks(tokens: DataFrame | Chunks, column: str = "terms") -> Chunks:
    return tokens if isinstance(tokens, Chunks) else chunked(tokens, column)


def first_seen(tokens: DataFrame | Chunks, empty_token: bool = False) -> DataFrame:
    """(term, term_id): ids from 0 in the order of first appearance by (doc_id, position).

    The order is global; ids are running totals over ranges of it, so no task sees the whole vocabulary. With
    empty_token, "" takes id 0.
    """
    first = _chunks(tokens).entries.groupBy(F.col("value").alias("term")).agg(F.min(F.struct("doc_id", "pos")).alias("at"))
    if empty_token:
        first = first.where("term <> ''")
    places = running_total(first.select("term", F.col("at.doc_id").alias("d"), F.col("at.pos").alias("p")), ["d", "p"], name="place")
    ids = places.select("term", (F.col("place") + (1 if empty_token else 0)).alias("term_id"))
    if empty_token:
        ids = ids.union(ids.sparkSession.createDataFrame([("", 0)], "term string, term_id bigint"))
    return ids


def sorted_ids(tokens: DataFrame | Chunks) -> DataFrame:
    """(term, term_id) without one task that sees all terms: sorted by range, numbered by partition offsets."""
    return running_total(_chunks(tokens).entries.select(F.col("value").alias("term")).distinct(), ["term"], name="term_id")


def encode(tokens: DataFrame | Chunks, vocab: DataFrame) -> DataFrame:
    """(doc_id, ids) in token order; unknown terms are dropped, repeats stay, empty documents too."""
    chunks = _chunks(tokens)
    known = vocab.select(F.col("term").alias("value"), F.col("term_id").cast("bigint").alias("out"))
    return translated(chunks, chunks.entries.join(known, "value"), "ids")


def decode(encoded: DataFrame, vocab: DataFrame, strict: bool = True) -> DataFrame:
    """(doc_id, terms) of encoded(doc_id, ids); an id that the vocabulary lacks raises, or is dropped."""
    chunks = chunked(encoded, "ids")
    each = chunks.entries.join(vocab.select(F.col("term_id").alias("value"), F.col("term").alias("out")), "value", "left" if strict else "inner")
    if strict:
        each = each.withColumn("out", F.when(F.col("out").isNull(), F.raise_error(F.concat(F.lit("unknown term id "), F.col("value").cast("string")))).otherwise(F.col("out")))
    return translated(chunks, each, "terms")


@dataclass
class Tokenizer:
    """A tokeniser with a vocabulary: lexicon(word, stem, term_id), term_id being that of the stem.

    update: True adds new words; False keeps the stems known and admits new words of them;
    "never" admits known words only; "if_empty" is True while there is no lexicon.
    """

    spark: SparkSession
    pattern: object = DEFAULT_PATTERN
    lower: bool = True
    stopwords: object = "en"
    stemmer: object = None
    lexicon: DataFrame | None = None

    def __post_init__(self) -> None:
        split_terms(F.lit(""), self.pattern)  # refuses what can't split

    def reset_vocab(self) -> None:
        self.lexicon = None

    def _words(self, chunks: Chunks) -> DataFrame:
        """Every word of a chunk, before stopwords, with whether it is one and where it is first."""
        kept = drop_stopwords(F.array("word"), self.stopwords)
        return chunks.entries.select(F.col("value").alias("word"), "doc_id", "pos").withColumn("stop", F.size(kept) == 0)

    def tokenize(self, docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", update: bool | str = "if_empty", return_as: str = "ids", allow_empty: bool = True) -> DataFrame:
        """(doc_id, ids), or (doc_id, terms) with return_as "string".

        With allow_empty, "" has id 0 and stands for a document that is left without tokens.
        """
        if update not in (True, False, "if_empty", "never"):
            raise ValueError(f"unknown update mode {update!r}")
        if return_as not in ("ids", "string"):
            raise ValueError(f"unknown return_as {return_as!r}")
        chunks = chunked(docs.select(F.col(id_col).alias("doc_id"), split_terms(F.col(text_col), self.pattern, self.lower).alias("terms")))
        words = self._words(chunks)
        if update == "if_empty":
            update = self.lexicon is None
        known = self.lexicon if self.lexicon is not None else self.spark.createDataFrame([("", "", 0)] if allow_empty else [], "word string, stem string, term_id bigint")
        if update is True or update is False:
            fresh = words.where("not stop").join(known, "word", "left_anti")
            stems = stem_lexicon(fresh, self.stemmer, "word", many=not callable(self.stemmer) or hasattr(self.stemmer, "stemWords")) if self.stemmer is not None else fresh.select(F.col("word").alias("term")).distinct().withColumn("stem", F.col("term"))
            ids = known.select("stem", "term_id").distinct()
            if update is True:
                order = fresh.groupBy("word").agg(F.min(F.struct("doc_id", "pos")).alias("at")).join(stems, F.col("word") == F.col("term"))
                new = order.groupBy("stem").agg(F.min("at").alias("at")).join(ids, "stem", "left_anti")
                start = (ids.agg(F.max("term_id")).first()[0])
                start = -1 if start is None else start
                places = running_total(new.select("stem", F.col("at.doc_id").alias("d"), F.col("at.pos").alias("p")), ["d", "p"], name="place")
                ids = ids.union(places.select("stem", F.col("place") + F.lit(start + 1)))
            known = known.union(stems.join(ids, "stem").select(F.col("term").alias("word"), "stem", "term_id"))
            self.lexicon = known
        # words that are known stay, whether stopwords or not
        value = "term_id" if return_as == "ids" else "stem"
        name = "ids" if return_as == "ids" else "terms"
        out = translated(chunks, chunks.entries.join(known.select(F.col("word").alias("value"), F.col(value).alias("out")), "value"), name)
        none = F.array(F.lit(0).cast("bigint")) if return_as == "ids" else F.array(F.lit(""))
        return out.withColumn(name, F.when(F.size(name) == 0, none).otherwise(F.col(name))) if allow_empty else out

    def vocab(self) -> DataFrame:
        """(term, term_id)."""
        return self.lexicon.select(F.col("stem").alias("term"), "term_id").distinct()

    def decode(self, encoded: DataFrame) -> DataFrame:
        return decode(encoded, self.vocab())

    def save(self, path: str) -> None:
        self.lexicon.write.mode("overwrite").parquet(f"{path}/lexicon")
        self.spark.createDataFrame([(json.dumps(self.stopwords),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/stopwords")

    def load(self, path: str) -> Tokenizer:
        self.lexicon = self.spark.read.parquet(f"{path}/lexicon")
        self.stopwords = json.loads(self.spark.read.text(f"{path}/stopwords").first()["value"])
        return self


def merge_vocabularies(a: DataFrame, b: DataFrame) -> DataFrame:
    """The distinct terms of both."""
    return a.select("term").union(b.select("term")).distinct()

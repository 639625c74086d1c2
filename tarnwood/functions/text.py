"""Tokenisation as column expressions.

Patterns over ``\\w`` are rewritten to Unicode classes that mean the same in the JVM; a
pattern that can't be, or a callable, runs as an Arrow-batched UDF.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.chunks import chunked, translated
from . import stemmer as _stemmer
from .stopwords import stopword_list

DEFAULT_PATTERN = r"(?u)\b\w\w+\b"
#: runs of two word characters or more, the same in Java, RE2 and Python
WORDS = r"[\p{L}\p{N}_]{2,}"
WORD_CLASS = r"[\p{L}\p{N}_]"


def jvm_pattern(pattern: str) -> str | None:
    """The pattern for the JVM, or None if only Python can run it."""
    if pattern in (DEFAULT_PATTERN, r"\b\w\w+\b", r"\w{2,}", r"\w\w+"):
        return WORDS
    if pattern in (r"\w+", r"(?u)\b\w+\b", r"\b\w+\b"):
        return WORD_CLASS + "+"
    if pattern in (r"\S+", r"(?u)\S+"):
        return r"\S+"
    if re.fullmatch(r"[\x20-\x7e]*", pattern) and not re.search(r"\\[bBwWdDsSpPkGAzZ]|\(\?", pattern) and re.compile(pattern).groups <= 1:
        return pattern
    return None


def split_terms(text: Column, pattern: str | Callable[[str], list[str]] = DEFAULT_PATTERN, lower: bool = True) -> Column:
    """array<string> of the tokens of a text; null is the empty text. "whitespace" splits at blanks."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    text = F.lower(text) if lower else text
    if pattern == "whitespace":
        return F.filter(F.split(text, r"\s+"), lambda t: t != "")
    if callable(pattern):
        run = pattern
    elif not isinstance(pattern, str):
        raise ValueError("the splitter must be a regular expression or a callable")
    elif jvm := jvm_pattern(pattern):
        return F.regexp_extract_all(text, F.lit(jvm), F.lit(re.compile(jvm).groups if "\\p" not in jvm else 0))
    else:
        run = re.compile(pattern).findall

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split(s: pd.Series) -> pd.Series:
        return s.map(lambda t: list(run(t)))

    return split(text)


def drop_stopwords(terms: Column, stopwords: str | bool | Sequence[str] | None) -> Column:
    """Tokens that aren't stopwords; repeats stay."""
    words = stopword_list(stopwords)
    return F.filter(terms, lambda t: ~t.isin(words)) if words else terms


def fill_empty(terms: Column, policy: str) -> Column:
    """policy "keep_empty" leaves an empty array; "empty_token" makes it one empty token."""
    if policy not in ("keep_empty", "empty_token"):
        raise ValueError(f"unknown policy {policy!r} for empty documents")
    return terms if policy == "keep_empty" else F.when(F.size(terms) == 0, F.array(F.lit(""))).otherwise(terms)


def stem_function(stemmer: object, many: bool = True) -> Callable[[list[str]], list[str]]:
    """A list-to-list stemmer from "english", a callable, or an object with stemWords or stemWord."""
    if stemmer in ("english", "en"):
        return _stemmer.stem_words
    if hasattr(stemmer, "stemWords"):
        return stemmer.stemWords
    if hasattr(stemmer, "stemWord"):
        return lambda words: [stemmer.stemWord(w) for w in words]
    if callable(stemmer):
        return stemmer if many else lambda words: [stemmer(w) for w in words]
    raise ValueError("the stemmer must be callable or have stemWords or stemWord")


def stem_lexicon(words: DataFrame, stemmer: object, word: str = "term", many: bool = True) -> DataFrame:
    """(term, stem) of distinct words: each is stemmed once, in Arrow batches."""
    run = stem_function(stemmer, many)

    @F.pandas_udf("string")
    def apply(s: pd.Series) -> pd.Series:
        return pd.Series(list(run(s.tolist())), index=s.index)

    return words.select(F.col(word).alias("term")).distinct().withColumn("stem", apply("term"))


def stem_terms(tokens: DataFrame, stemmer: object, many: bool = True) -> DataFrame:
    """tokens(doc_id, terms) with each term replaced by its stem, order kept."""
    chunks = chunked(tokens)
    stems = stem_lexicon(chunks.entries, stemmer, "value", many).select(F.col("term").alias("value"), F.col("stem").alias("out"))
    return translated(chunks, chunks.entries.join(stems, "value"), "terms")


def tokenize(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", pattern: str | Callable = DEFAULT_PATTERN, lower: bool = True, stopwords: str | bool | Sequence[str] | None = None, stemmer: object = None, empty: str = "keep_empty") -> DataFrame:
    """(doc_id, terms) of each document. Narrow, unless a stemmer is given."""
    terms = drop_stopwords(split_terms(F.col(text_col), pattern, lower), stopwords)
    tokens = docs.select(F.col(id_col).alias("doc_id"), terms.alias("terms"))
    if stemmer is not None:
        tokens = stem_terms(tokens, stemmer)
    return tokens.withColumn("terms", fill_empty(F.col("terms"), empty)) if empty != "keep_empty" else tokens

"""Tokenising, stopwords, stemming and vocabularies."""

import re

import pytest
from pyspark.sql import functions as F

from tarnwood.functions import stemmer
from tarnwood.functions.params import RankParams
from tarnwood.functions.stopwords import languages, stopword_list
from tarnwood.functions.text import tokenize
from tarnwood.operators.lexicon import Tokenizer, decode, encode, first_seen, merge_vocabularies, sorted_ids


def _docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def _terms(df):
    return [r[1] for r in sorted(df.collect(), key=lambda r: r[0])]


def test_default_pattern_is_that_of_python(spark):
    texts = ["A cat's über-naïve I x2 _a", "½ Ⅷ x² 中文 字", "", None, "a b c"]
    want = [re.findall(r"(?u)\b\w\w+\b", (t or "").lower()) for t in texts]
    assert _terms(tokenize(_docs(spark, texts))) == want


@pytest.mark.parametrize("pattern, want", [(r"\w+", ["a", "b2"]), (r"(\w)\w", ["b"]), (r"(?i)[AB]", ["a", "b"]), ("whitespace", ["a,", "b2"]), (lambda t: t.split(","), ["a", " b2"])])
def test_other_splitters(spark, pattern, want):
    assert _terms(tokenize(_docs(spark, ["A, B2"]), pattern=pattern)) == [want]


def test_bad_splitter_and_policy(spark):
    with pytest.raises(ValueError):
        tokenize(_docs(spark, ["a"]), pattern=3)
    with pytest.raises(ValueError):
        tokenize(_docs(spark, ["a"]), empty="other")


def test_stopwords(spark):
    assert len(stopword_list("en")) == 33 and len(stopword_list("en_plus")) == 179 and len(languages()) == 14
    assert stopword_list(True) == stopword_list("english") and stopword_list(None) == [] == stopword_list(False)
    with pytest.raises(ValueError):
        stopword_list("xx")
    assert _terms(tokenize(_docs(spark, ["the cat and the hat"]), stopwords="en")) == [["cat", "hat"]]
    assert _terms(tokenize(_docs(spark, ["der hund bellt"]), stopwords=["hund"])) == [["der", "bellt"]]


@pytest.mark.parametrize("word, stem", [("caresses", "caress"), ("ponies", "poni"), ("running", "run"), ("happy", "happi"), ("national", "nation"), ("generously", "generous"), ("consistency", "consist"), ("hopping", "hop"), ("hoping", "hope"), ("skies", "sky"), ("dying", "die"), ("knack", "knack"), ("abilities", "abil")])
def test_stemmer(word, stem):
    assert stemmer.stem(word) == stem


def test_stemming_keeps_order_and_repeats(spark):
    got = _terms(tokenize(_docs(spark, ["running cats run", "", "cats cats"]), stemmer="english", empty="empty_token"))
    assert got == [["run", "cat", "run"], [""], ["cat", "cat"]]
    assert _terms(tokenize(_docs(spark, ["ab cd"]), stemmer=lambda words: [w[::-1] for w in words])) == [["ba", "dc"]]
    with pytest.raises(ValueError):
        tokenize(_docs(spark, ["ab"]), stemmer=3)


def test_encode_and_decode(spark):
    t = tokenize(_docs(spark, ["bb aa bb", "", "cc aa"]))
    vocab = first_seen(t)
    assert {r.term: r.term_id for r in vocab.collect()} == {"bb": 0, "aa": 1, "cc": 2}
    assert {r.term: r.term_id for r in sorted_ids(t).collect()} == {"aa": 0, "bb": 1, "cc": 2}
    assert _terms(encode(t, vocab)) == [[0, 1, 0], [], [2, 1]]
    assert _terms(decode(encode(t, vocab), vocab)) == _terms(t)
    unknown = spark.createDataFrame([(0, [1, 9])], "doc_id bigint, ids array<bigint>")
    assert _terms(decode(unknown, vocab, strict=False)) == [["aa"]]
    with pytest.raises(Exception, match="unknown term id 9"):
        decode(unknown, vocab).collect()
    assert merge_vocabularies(vocab, vocab).count() == 3


def test_tokenizer_modes(spark):
    tok = Tokenizer(spark, stopwords=None)
    assert _terms(tok.tokenize(_docs(spark, ["hello world", ""]))) == [[1, 2], [0]]
    assert _terms(tok.tokenize(_docs(spark, ["hello new world"]), update="never")) == [[1, 2]]
    assert _terms(tok.tokenize(_docs(spark, ["unheard"]), update="never")) == [[0]]
    assert _terms(tok.tokenize(_docs(spark, ["new hello"]), update=True)) == [[3, 1]]
    assert _terms(tok.tokenize(_docs(spark, ["new"]), return_as="string")) == [["new"]]
    for bad in ({"update": "maybe"}, {"return_as": "other"}):
        with pytest.raises(ValueError):
            tok.tokenize(_docs(spark, ["a"]), **bad)
    tok.reset_vocab()
    assert tok.lexicon is None


def test_tokenizer_admits_words_of_known_stems(spark):
    tok = Tokenizer(spark, stopwords=None, stemmer=stemmer.stem)
    tok.tokenize(_docs(spark, ["running"]), update=True)
    assert _terms(tok.tokenize(_docs(spark, ["runs cat"]), update=False)) == [[1]]


def test_tokenizer_is_kept(spark, tmp_path):
    tok = Tokenizer(spark, stopwords=["the"])
    tok.tokenize(_docs(spark, ["the cat"]))
    tok.save(str(tmp_path))
    again = Tokenizer(spark).load(str(tmp_path))
    assert again.stopwords == ["the"] and {r.term for r in again.vocab().collect()} == {"", "cat"}


@pytest.mark.parametrize("bad", [{"method": "x"}, {"idf_method": "x"}, {"dtype": "int8"}])
def test_bad_parameters(bad):
    with pytest.raises(ValueError):
        RankParams(**bad)


def test_catalogue_stems_each_document(spark):
    from tarnwood.plans import catalogue

    sf = "/root/testdata/sf0.001"
    stems = {r.doc_id: r.terms for r in catalogue.stem_docs(spark, sf).collect()}
    plain = {r.doc_id: r.terms for r in catalogue.tokenize_stopwords(spark, sf).collect()}
    assert stems == {d: " ".join(stemmer.stem(w) for w in t.split(" ")) if t else "" for d, t in plain.items()}
    assert F is not None

"""Scores, retrieval, masks, keeping and growing an index, metrics."""

import math

import pytest
from pyspark.sql import functions as F

from tarnwood.functions.params import METHODS, RankParams
from tarnwood.operators import index as ix
from tarnwood.operators import retrieve as rt
from tarnwood.operators.staging import running_total
from tarnwood.timing import Timer, peak_memory_mb
from tarnwood.operators.metrics import evaluate, judged_queries, metric_cutoff

ANIMALS = ["a cat is a feline and likes to purr", "a dog is the human's best friend and loves to play", "a bird is a beautiful animal that can fly", "a fish is a creature that lives in water and swims"]
GOLD = {
    "robertson": [0.744877, 0.0, 0.0, 0.338919],
    "lucene": [1.058438, 0.0, 0.0, 0.481589],
    "atire": [3.046801, 0.0, 0.0, 1.386294],
    "bm25l": [3.929633, 2.257449, 2.257449, 3.009932],
    "bm25+": [5.951383, 2.414157, 2.414157, 4.023595],
}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(ANIMALS)), "doc_id bigint, text string")


def ask(spark, *terms):
    return spark.createDataFrame([(i, list(t)) for i, t in enumerate(terms)], "query_id bigint, terms array<string>")


QUERY = ["does", "fish", "purr", "like", "cat"]


@pytest.mark.parametrize("method", METHODS)
def test_scores(spark, docs, method):
    index = ix.build_index(docs, RankParams(method=method), stopwords="en")
    got = {r.doc_id: r.score for r in rt.score_all(index, ask(spark, QUERY)).collect()}
    assert [got[i] for i in range(4)] == pytest.approx(GOLD[method], abs=1e-6)


@pytest.mark.parametrize("tf", METHODS)
@pytest.mark.parametrize("idf", ["robertson", "bm25+"])
def test_formulas_mix(spark, docs, tf, idf):
    index = ix.build_index(docs, RankParams(k1=1.2, b=0.6, delta=0.7, method=tf, idf_method=idf), stopwords="en")
    lens, n, df = [4, 6, 5, 5], 4, 1
    rare = math.log(max(1, (n - df + 0.5) / (df + 0.5))) if idf == "robertson" else math.log((n + 1) / df)

    def weight(f, length):
        z = 0.4 + 0.6 * length / 5
        c = f / z + 0.7
        return {"robertson": f / (1.2 * z + f), "lucene": f / (1.2 * z + f), "atire": 2.2 * f / (f + 1.2 * z), "bm25l": 2.2 * c / (1.2 + c), "bm25+": 2.2 * f / (1.2 * z + f) + 0.7}[tf]

    got = {r.doc_id: r.score for r in rt.score_all(index, ask(spark, ["cat", "cat"])).collect()}
    shifted = tf in ("bm25l", "bm25+")
    for d in range(4):
        want = 2 * rare * weight(1 if d == 0 else 0, lens[d]) if d == 0 or shifted else 0.0
        assert got[d] == pytest.approx(want, abs=1e-6)


def test_goldens(spark, docs):
    index = ix.build_index(docs, RankParams(method="bm25+"), stopwords="en", stemmer="english")
    asked = rt.analyse_queries(index, spark.createDataFrame([(0, "a cat is a feline, it's sometimes beautiful but cannot fly"), (1, "cat feline dog bird fish")], "query_id bigint, text string"))
    assert rt.to_matrix(rt.retrieve(index, asked.where("query_id = 0"), 2))[0] == [[0, 2]]
    mask = spark.createDataFrame([(0, 1), (1, 0), (2, 0), (3, 1)], "doc_id bigint, weight int")
    rt.check_mask(index, mask)
    for mode in ("pre", "post"):
        assert rt.to_matrix(rt.retrieve(index, asked.where("query_id = 1"), 2, mask, mode))[0] == [[0, 3]]


def test_zero_scores_fill_up(spark, docs):
    index = ix.build_index(docs, stopwords="en")
    ids, scores = rt.to_matrix(rt.retrieve(index, ask(spark, ["fly"], ["unheard"], []), 3))
    assert ids == [[2, 0, 1], [0, 1, 2], [0, 1, 2]] and scores[1] == scores[2] == [0.0] * 3
    assert rt.retrieve(index, ask(spark, ["fly"], ["unheard"]), 3, fill=False).count() == 1
    assert rt.retrieve(index, ask(spark, ["fly"]), 0).count() == 0


@pytest.mark.parametrize("method", METHODS)
@pytest.mark.parametrize("mode", ["pre", "post"])
def test_top_k_is_that_of_the_dense_scores(spark, docs, method, mode):
    index = ix.build_index(docs, RankParams(method=method))
    mask = spark.createDataFrame([(0, 0.5), (1, 2.0), (3, -1.0)], "doc_id bigint, weight double")
    asked = ask(spark, ["is", "cat", "and"], ["that", "fish"], [])
    dense = {}
    for r in rt.score_all(index, asked, mask, mode).collect():
        dense.setdefault(r.query_id, []).append((-r.score, r.doc_id))
    for k in (1, 2, 4):
        assert rt.to_matrix(rt.retrieve(index, asked, k, mask, mode))[0] == [[d for _, d in sorted(dense[q])[:k]] for q in sorted(dense)]


def test_arguments_are_checked(spark, docs):
    index = ix.build_index(docs)
    for bad in ({"k": 5}, {"k": -1}, {"k": 1, "mask_mode": "x"}):
        with pytest.raises(ValueError):
            rt.retrieve(index, ask(spark, ["cat"]), **bad)
    for rows in ([(0, 1.0), (0, 2.0)], [(9, 1.0)]):
        with pytest.raises(ValueError):
            rt.check_mask(index, spark.createDataFrame(rows, "doc_id bigint, weight double"))
    with pytest.raises(ValueError):
        rt.check_mask(index, docs)
    with pytest.raises(ValueError):
        ix.build_index_from_terms(docs.withColumnRenamed("text", "terms"))


def test_input_forms_agree(spark, docs):
    ids = spark.createDataFrame([(0, [7, 900]), (1, [900]), (2, [])], "doc_id bigint, terms array<bigint>")
    words = spark.createDataFrame([(0, ["7", "900"]), (1, ["900"]), (2, [])], "doc_id bigint, terms array<string>")
    asked = ask(spark, ["7", "900", "900"])
    for method in METHODS:
        a, b = (rt.to_matrix(rt.retrieve(ix.build_index_from_terms(t, RankParams(method=method)), asked, 3)) for t in (ids, words))
        assert a == b


def test_empty_corpus(spark, docs):
    index = ix.build_index(docs.limit(0))
    assert rt.retrieve(index, ask(spark, ["cat"]), 0).count() == 0
    assert index.describe().first().asDict() == {"n_docs": 0, "n_terms": 0, "n_postings": 0, "postings_per_doc": 0.0, "avgdl": 0.0}


def test_saved_index(spark, docs, tmp_path):
    at = str(tmp_path / "index")
    index = ix.build_index(docs, RankParams(method="bm25l"), stopwords="en")
    index.save(at)
    loaded = ix.load_index(spark, at)
    asked = ask(spark, QUERY, ["bird"])
    assert rt.to_matrix(rt.retrieve(loaded, asked, 4)) == rt.to_matrix(rt.retrieve(index, asked, 4))
    scan = loaded.postings.where(F.col("term_bucket").isin(1) & F.col("term").isin("cat"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(term_bucket" in scan and "EqualTo(term,cat)" in scan
    other = ix.load_index(spark, at, method="lucene")
    assert rt.to_matrix(rt.retrieve(other, asked, 4)) == rt.to_matrix(rt.retrieve(ix.build_index(docs, stopwords="en"), asked, 4))
    other.save(str(tmp_path / "second"))
    assert ix.load_index(spark, str(tmp_path / "second")).params.method == "lucene"


def test_grown_index_and_large_batches(spark, docs, tmp_path, monkeypatch):
    asked = ask(spark, QUERY)
    whole = rt.to_matrix(rt.retrieve(ix.build_index(docs), asked, 4))
    part = ix.build_index(docs.where("doc_id < 2"))
    assert rt.to_matrix(rt.retrieve(part.append(docs.where("doc_id >= 2")), asked, 4)) == whole
    at = str(tmp_path / "index")
    part.save(at)
    assert rt.to_matrix(rt.retrieve(ix.load_index(spark, at).append(docs.where("doc_id >= 2")), asked, 4)) == whole
    ix.build_index(docs).save(at + "2")
    for name in ("TERM_LIMIT", "ROW_LIMIT"):
        monkeypatch.setattr(rt, name, 1)
        assert rt.to_matrix(rt.retrieve(ix.load_index(spark, at + "2"), asked, 4)) == whole


def test_partitions_and_narrow_scores(spark, docs):
    asked = ask(spark, QUERY)
    a = rt.to_matrix(rt.retrieve(ix.build_index(docs.repartition(1)), asked, 4))
    assert a == rt.to_matrix(rt.retrieve(ix.build_index(docs.repartition(8)), asked, 4))
    narrow = rt.retrieve(ix.build_index(docs, RankParams(dtype="float32")), asked, 4)
    assert dict(narrow.dtypes)["score"] == "float" and rt.merge_results([narrow, narrow]).count() == 8


def test_metrics(spark):
    qrels = spark.createDataFrame([("q", "a", 2), ("q", "b", 1), ("q", "c", 0), ("r", "x", 1), ("none", "a", 1)], "query_id string, doc_id string, rel int")
    results = spark.createDataFrame([("q", "a", 3.0), ("q", "z", 2.0), ("q", "b", 1.0), ("q", "q", 9.0), ("r", "y", 1.0), ("other", "a", 1.0)], "query_id string, doc_id string, score double")
    got = {r.k: r for r in evaluate(qrels, results, (1, 3)).collect()}
    ndcg = (2 + 1 / 2) / (2 + 1 / math.log2(3))
    assert got[1].ndcg == 0.5 and got[1].precision == 0.5 and got[1].recall == 0.25
    assert got[3].ndcg == pytest.approx(ndcg / 2, abs=1e-5) and got[3].map == pytest.approx((1 + 2 / 3) / 2 / 2, abs=1e-5) and got[3].recall == 0.5
    assert judged_queries(results, qrels).select("query_id").distinct().count() == 2 and metric_cutoff("NDCG@10") == "10"


def test_masks_and_ids_are_checked_in_the_call(spark, docs):
    index, asked = ix.build_index(docs), ask(spark, ["cat"])
    for rows in ([(0, 1.0), (0, 2.0)], [(99, 1.0)]):
        with pytest.raises(ValueError):
            rt.retrieve(index, asked, 1, spark.createDataFrame(rows, "doc_id bigint, weight double"))
    ids = ix.build_index_from_terms(spark.createDataFrame([(0, [0, 1]), (1, [2])], "doc_id bigint, terms array<bigint>"))
    for bad in ([3], [-1], [0, 7]):
        with pytest.raises(ValueError):
            rt.retrieve(ids, spark.createDataFrame([(0, bad)], "query_id bigint, terms array<bigint>"), 1)
    assert rt.to_matrix(rt.retrieve(ids, spark.createDataFrame([(0, [2])], "query_id bigint, terms array<bigint>"), 1))[0] == [[1]]
    with pytest.raises(ValueError):
        index.append(docs.limit(1))


def test_unsorted_and_batched_results(spark, docs, tmp_path):
    index = ix.build_index(docs)
    asked = ask(spark, ["cat"], ["fish"], ["bird", "cat"])
    whole = rt.retrieve(index, asked, 2)
    loose = rt.retrieve(index, asked, 2, sorted=False)
    assert loose.columns == ["query_id", "doc_id", "score"] and sorted(loose.collect()) == sorted(whole.drop("rank").collect())
    index.save(f"{tmp_path}/index")
    got = rt.retrieve_batches(f"{tmp_path}/index", asked, f"{tmp_path}/out", 2, size=2)
    assert sorted(map(str, got.select(whole.columns).collect())) == sorted(map(str, whole.collect()))


def test_running_total(spark):
    rows = [(i % 7, i, (i * 37) % 11) for i in range(500)]
    df = spark.createDataFrame(rows, "a int, b bigint, v bigint").repartition(5)
    total, want = 0, {}
    for a, b, v in sorted(rows):
        want[a, b] = total
        total += v
    assert {(r.a, r.b): r.before for r in running_total(df, ["a", "b"], "v").collect()} == want
    assert running_total(df.limit(0), ["a", "b"]).count() == 0


def test_timer():
    t = Timer()
    for _ in range(2):
        with t.step("a"):
            pass
    assert t.report()[0][:2] == ("a", 2) and peak_memory_mb() > 1

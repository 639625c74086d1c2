"""Steps whose cost must not outgrow their input: what they shuffle, and that blocks give the whole result."""

import re

import pytest
from pyspark.sql import functions as F

from tarnwood.functions.params import RankParams
from tarnwood.functions.scoring import rounded
from tarnwood.operators import index as ix
from tarnwood.operators import retrieve as rt
from tarnwood.operators.metrics import evaluate
from tarnwood.streaming import text_streams as ts


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(i % 7)) + " same same" * (i % 3)) for i in range(40)]
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)


def test_postings_are_shuffled_once(spark, docs):
    index = ix.build_index(docs)
    assert "hashpartitioning" not in plan(index.tf)
    assert plan(index.postings.select("term", "doc_id", "tf", "score")).count("Exchange hashpartitioning") == 1
    got = {(r.term, r.doc_id): (r.tf, r.dl) for r in index.tf.collect()}
    assert got["same", 2] == (4, 6) and got["w0", 1] == (1, 3) and len(got) == sum(i % 7 + (i % 3 > 0) for i in range(40))
    odd = spark.createDataFrame([(0, ["a", None, "a"]), (1, []), (2, None)], "doc_id bigint, terms array<string>")
    assert [(r.term, r.doc_id, r.tf) for r in ix.term_rows(odd).collect()] == [("a", 0, 2)]


def test_pairs_are_not_shuffled(spark, docs):
    index = ix.build_index(docs)
    asked = spark.createDataFrame([(q, ["same", f"w{q}"]) for q in range(5)], "query_id bigint, terms array<string>")
    pairs = re.compile(r"hashpartitioning\(query_id#\w+, doc_id")
    assert not pairs.search(plan(rt.hits(index, rt.query_terms(asked)))) and not pairs.search(plan(rt.score_all(index, asked)))


def test_blocks_of_queries(spark, docs, monkeypatch):
    asked = spark.createDataFrame([(q, ["same", f"w{q % 7}", "w0"]) for q in range(9)], "query_id bigint, terms array<string>")
    index = ix.build_index(docs, RankParams(method="bm25l"))
    whole, dense = rt.to_matrix(rt.retrieve(index, asked, 5)), sorted(rt.score_all(index, asked).collect())
    monkeypatch.setattr(rt, "ROW_LIMIT", 10)
    monkeypatch.setattr(rt, "BLOCKS", 2)
    monkeypatch.setattr(rt, "PAIRS", 50)
    monkeypatch.setattr(rt, "TASKS", 2)
    monkeypatch.setattr(rt, "SHARE", 2)
    assert rt.to_matrix(rt.retrieve(index, asked, 5)) == whole and sorted(rt.score_all(index, asked).collect()) == dense


def test_offsets_have_no_single_task(spark, docs):
    offsets = ix.build_index(docs).offsets()
    assert "SinglePartition" not in plan(offsets)
    rows = sorted(offsets.collect())
    assert rows[0].start == 0 and all(a.stop == b.start for a, b in zip(rows, rows[1:]))


def test_rounding_is_that_of_the_sql(spark):
    import duckdb

    values = [77.05545, 81.83115, 35.88925, -1.00005, 0.0, 2.5]
    got = [r.r for r in spark.createDataFrame([(v,) for v in values], "v double").select(rounded("v", 4).alias("r")).collect()]
    assert got == [x[0] for v in values for x in duckdb.execute("select round(?::double, 4)", [v]).fetchall()]


def test_streamed_counts_stay_in_the_row(spark, tmp_path):
    at = str(tmp_path / "in")
    long = " ".join(f"word{i} word{i % 10}" for i in range(20_000))
    spark.createDataFrame([(0, long), (1, "word1 word1")], "doc_id bigint, text string").coalesce(1).write.parquet(at)
    counts = ts.stream_term_counts(spark.read.parquet(at))
    assert "filter(" not in plan(counts)
    got = {r.term: (r.df, r.tf) for r in counts.collect()}
    assert got["word1"] == (2, 2003) and got["word19999"] == (1, 1) and len(got) == 20_000


def test_judgements_are_not_sorted(spark):
    qrels = spark.range(3000).select((F.col("id") % 3).alias("query_id"), F.col("id").alias("doc_id"), (F.col("id") % 4).alias("rel"))
    results = spark.createDataFrame([(q, d, 1.0 / (d + 1)) for q in range(3) for d in range(q, 60, 3)], "query_id bigint, doc_id bigint, score double")
    got = evaluate(qrels, results, (1, 10))
    assert "WindowGroupLimit" not in plan(got)
    rows = {r.k: r for r in got.collect()}
    assert rows[10].precision == pytest.approx(sum(sum(d % 4 > 0 for d in [x for x in range(q, 60, 3) if x != q][:10]) for q in range(3)) / 30, abs=1e-5)


def test_tokens_are_translated_in_chunks(spark):
    from tarnwood.operators import lexicon as lx

    words = [[f"w{(i * j) % 11}" for j in range(i)] + ["odd"] * (i == 3) for i in range(12)]
    tokens = spark.createDataFrame([(11 - i, w) for i, w in enumerate(words)], "doc_id bigint, terms array<string>").repartition(3)
    seen = {}
    for _, w in sorted((11 - i, w) for i, w in enumerate(words)):
        for x in w:
            seen.setdefault(x, len(seen))
    vocab = lx.first_seen(tokens)
    assert {r.term: r.term_id for r in vocab.collect()} == seen
    ids = lx.encode(tokens, vocab.where("term <> 'odd'"))
    assert "FlatMapCoGroupsInArrow" in plan(ids)  # and no row a token
    assert {r.doc_id: r.ids for r in ids.collect()} == {11 - i: [seen[x] for x in w if x != "odd"] for i, w in enumerate(words)}
    assert {r.doc_id: r.terms for r in lx.decode(ids, vocab).collect()} == {11 - i: [x for x in w if x != "odd"] for i, w in enumerate(words)}


def test_all_pairs_of_vectors(spark, monkeypatch):
    import numpy as np
    from tarnwood.llm import e8

    rng = np.random.default_rng(3)
    centre = rng.standard_normal((6, 16))
    x = np.concatenate([c + 0.21 * rng.standard_normal((40, 16)) for c in centre])
    monkeypatch.setattr(e8, "ALL_ROWS", 50)
    got = {r.vec_id: r.links for r in e8.similar_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>"), exact=True).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.95).sum(1) - 1
    assert want.sum() > 500 and [got[i] for i in range(len(x))] == want.tolist()

"""Loaders, the small interface, the command line, streams and the driver contract."""

import json
import subprocess
import sys
from pathlib import Path

import pytest

from tarnwood import cli
from tarnwood.operators.retrieve import analyse_queries, retrieve, to_matrix
from tarnwood.search import Search, tool_functions
from tarnwood.sources import loaders
from tarnwood.streaming import text_streams as ts

TEXTS = ["hello world", "goodbye moon", "the quick fox"]


def _write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def _rows(df):
    return [(r.doc_id, r.text) for r in df.orderBy("doc_id").collect()]


def test_files(spark, tmp_path):
    want = list(enumerate(TEXTS))
    lines = "".join(json.dumps({"text": t, "n": i}) + "\n\n" for i, t in want)
    files = [
        _write(tmp_path / "a.txt", "  hello world \n\n goodbye moon\nthe quick fox\n"),
        _write(tmp_path / "a.json", json.dumps(TEXTS)),
        _write(tmp_path / "b.json", json.dumps([{"text": t, "n": 1} for t in TEXTS])),
        _write(tmp_path / "a.jsonl", lines),
        _write(tmp_path / "a.csv", "text,n\n" + "".join(f'"{t}",1\n' for t in TEXTS)),
    ]
    for f in files:
        assert _rows(loaders.load(spark, f)) == want, f
    assert [t for _, t in _rows(loaders.load(spark, files[3], "n"))] == ["0", "1", "2"]
    assert loaders.load(spark, _write(tmp_path / "e.json", "[]")).count() == 0


@pytest.mark.parametrize("name, text, column", [("x.json", '{"a": 1}', None), ("x.jsonl", '{"a": "1"}\n{"b": "2"}\n', None), ("x.csv", "a,b\n1,2\n", "c"), ("x.xml", "<a/>", None)])
def test_bad_files(spark, tmp_path, name, text, column):
    with pytest.raises(ValueError):
        loaders.load(spark, _write(tmp_path / name, text), column).collect()


def test_driver_items_and_lookup(spark):
    df = loaders.documents(spark, ["valid", {"text": "dict"}, None, 12345])
    assert _rows(df) == [(0, "valid"), (1, "dict")]
    assert _rows(loaders.lookup(df, 1)) == [(1, "dict")] and _rows(loaders.lookup(df, [0, 1])) == _rows(df) == _rows(loaders.lookup(df, slice(0, 2)))
    for bad in ("1", True):
        with pytest.raises(TypeError):
            loaders.lookup(df, bad)


def test_collections(spark, tmp_path):
    for name in ("one", "two"):
        d = tmp_path / name
        (d / "qrels").mkdir(parents=True)
        _write(d / "corpus.jsonl", '{"_id": "1", "text": "t"}\n')
        _write(d / "queries.jsonl", '{"_id": "q", "text": "t", "extra": 1}\n')
        _write(d / "qrels" / "test.tsv", "query-id\tcorpus-id\tscore\nq\t1\t1\nq\t2\t0\n")
    at = str(tmp_path)
    assert loaders.load_corpus(spark, f"{at}/one").first().asDict() == {"id": "1", "text": "t", "title": None}
    assert "extra" not in loaders.load_records(spark, f"{at}/one/queries.jsonl", remove=["extra"]).columns
    with pytest.raises(KeyError):
        loaders.load_records(spark, f"{at}/one/queries.jsonl", remove=["absent"])
    assert loaders.load_qrels(spark, f"{at}/one").count() == 2 and loaders.load_qrels(spark, f"{at}/one", last_per_query=True).first().doc_id == "2"
    with pytest.raises(ValueError):
        loaders.load_qrels(spark, f"{at}/one", "other")
    assert {r.id for r in loaders.merge_collections(spark, at).collect()} == {"one_1", "two_1"}
    assert {r.query_id for r in loaders.merge_judgements(spark, at).collect()} == {"one_q", "two_q"}


def test_search(spark, tmp_path):
    engine = Search(spark, TEXTS)
    found = engine.search(["hello", ""], k=10)
    assert [h["id"] for h in found[0]] == [0, 1, 2] and found[0][0]["score"] > 0 and found[1] == []
    assert found[0][0]["document"]["text"] == "hello world"
    with pytest.raises(ValueError):
        Search(spark, TEXTS, language="german")
    at = str(tmp_path / "i")
    engine.save(at)
    assert Search.open(spark, at).search(["hello"], 1)[0][0]["id"] == 0
    tools = tool_functions(spark, at)
    assert tools["get_info"]()["n_docs"] == 3 and tools["retrieve"]("moon", 1).startswith("1. [")


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setenv("TARNWOOD_HOME", str(tmp_path))
    f = _write(tmp_path / "d.txt", "\n".join(TEXTS))
    assert cli.main(["index", f, "-o", "mine", "-u"], spark) == 0 and cli.list_indexes() == ["mine"]
    out = tmp_path / "r.json"
    assert cli.main(["search", "hello", "-i", "mine", "-u", "-k", "3", "-s", str(out)], spark) == 0
    saved = json.loads(out.read_text())
    assert saved["num_results"] == 3 and saved["total_documents"] == 3 and "hello world" in capsys.readouterr().out
    assert cli.choose_index(["a", "b"], lambda _: "2") == "b" and cli.clip("x" * 300).endswith("...")
    with pytest.raises(ValueError):
        cli.choose_index(["a"], lambda _: "7")
    with pytest.raises(SystemExit):
        cli.main(["search", "hello"], spark)


def test_streams(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    src = str(tmp_path / "in")
    docs.coalesce(1).write.parquet(src)
    counts = ts.drain(ts.stream_term_counts(ts.read_documents(spark, src)), "counts", "complete")
    assert {r.term: (r.df, r.tf) for r in counts.collect()}["hello"] == (1, 1)
    at = str(tmp_path / "kept")
    ts.ingest(ts.read_documents(spark, src), at, at + "-progress").awaitTermination()
    more = spark.createDataFrame([(3, "hello hello fox")], "doc_id bigint, text string")
    more.coalesce(1).write.mode("append").parquet(src)
    ts.ingest(ts.read_documents(spark, src), at, at + "-progress").awaitTermination()
    index = ts.open_ingested(spark, at)
    assert index.n_docs == 4
    asked = str(tmp_path / "asked")
    spark.createDataFrame([(5, "hello fox")], "query_id bigint, text string").write.parquet(asked)
    got = []
    ts.answer(index, ts.read_documents(spark, asked), lambda df, n: got.extend(df.collect()), k=2).awaitTermination()
    assert [r.doc_id for r in sorted(got, key=lambda r: r.rank)] == [3, 2] or [r.doc_id for r in got][0] == 3
    plain = retrieve(index, analyse_queries(index, spark.read.parquet(asked)), 2)
    assert to_matrix(plain)[0] == [[r.doc_id for r in sorted(got, key=lambda r: r.rank)]]


def test_driver_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["query_id", "rank", "doc_id", "score"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_stands_without_llm(tmp_path):
    import shutil

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "tarnwood", tmp_path / "tarnwood", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    run = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') for n in e.queries()), 'pipeline' in e.queries())"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert run.stdout.split()[1:] == ["False", "False"], run.stderr

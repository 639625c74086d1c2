"""Operators on Spark against slow versions and SQL, and their odd cases."""

import pathlib
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tarnwood.llm import ctph, e8, line_dedup, merkle, mixing, packing, pii_crf, ppm_langid, queries, simhash_trie, suffix_index
from tarnwood.llm.common import components, text_hash
from tarnwood.operators.staging import shared_dir

from . import brute

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
R = random.Random(12)
EN = [R.choice(["th", "wh", "st"]) + R.choice(["is", "at", "en", "or"]) + R.choice(["", "ing", "ed", "ly"]) for _ in range(60)]
DE = [R.choice(["sch", "kr", "ei"]) + R.choice(["auf", "en", "üb"]) + R.choice(["", "heit", "ung", "lich"]) for _ in range(60)]


def prose(words, n):
    return " ".join(R.choice(words) + ("." if R.random() < 0.1 else "") for _ in range(n))


def corpus():
    """Prose, copies, near copies, shared lines and passages, noise, nulls, empty and long texts, repeated rows."""
    rows = []
    for i in range(24):
        words, lang = ((EN, "en"), (DE, "de"))[i % 2]
        rows.append([i, "\n".join(prose(words, R.randint(8, 40)) for _ in range(R.randint(1, 5))), lang, "abc"[i % 3]])
    rows.append([30, rows[0][1], "en", "a"])  # a copy
    w = rows[2][1].split(" ")
    w[3] = "changed"
    rows.append([31, " ".join(w), "en", "b"])  # a near copy
    block = "\n".join(prose(EN, 9) for _ in range(3))
    rows += [[32 + k, prose(EN, 30) + "\n" + block + "\n" + prose(EN, 25), "en", "c"] for k in range(3)]
    shared = prose(DE, 70)
    rows += [[36 + k, prose(DE, 20) + " " + shared + " " + prose(DE, 15), "de", "a"] for k in range(2)]
    rows += [[40, "".join(chr(R.randint(33, 0x2FF)) for _ in range(3000)), "en", "a"], [41, prose(EN, 40_000), "en", "b"]]
    rows += [[42, None, None, None], [43, "", "en", "a"], [None, prose(EN, 50), "en", None], [44, "   \n \n", "en", "a"], [45, "one", "en", "b"]]
    rows += [list(rows[5]), [5, prose(EN, 12), "en", "b"]]  # a repeated row; an id with another text
    return [(d, t, lang, s, None if t is None else len(t)) for d, t, lang, s in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def listed(df):
    keyed = df.withColumn("key", text_hash(F.col("text")))
    return [r.asDict() for r in keyed.collect()]


def bag(rows):
    return sorted((tuple((c, str(v)) for c, v in sorted(r.items()) if c != "key") for r in rows))


def clashing(df):
    """With columns that are named as helpers of the operators are."""
    for c in ("row", "k", "d", "key", "text_key", "fp", "s1", "pos", "line", "shard", "tokens", "pass", "block", "h", "runs", "uses", "batch", "prefix", "window", "t", "dim", "node", "hash", "slot", "type"):
        df = df.withColumn(c, F.lit("x"))
    return df


# SQL


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    columns = sorted(c[0] for c in want.description)
    want = want.fetchdf()[columns].astype(str)
    got = queries.queries()[name](spark, SF).toPandas()[columns].astype(str)
    clean = lambda x: sorted(tuple(v.replace(".0", "").replace("nan", "<NA>").replace("None", "<NA>") for v in r) for r in x.itertuples(index=False))
    assert clean(got) == clean(want)


# line dedup, near-dedup, mixing, packing, language


def test_line_dedup(docs):
    assert bag(listed(line_dedup.line_dedup(docs))) == bag(brute.line_dedup(listed(docs)))


@pytest.mark.parametrize("min_chars", [1, 7, 24])
def test_line_runs_of_any_length(spark, min_chars):
    r = random.Random(min_chars)
    rows = [(i, "\n".join(r.choice(["", "", " ", "a", "é", "bb", "ccc", "dddd eeee ffff", f"own {i}"]) for _ in range(r.randint(1, 14)))) for i in range(60)]
    rows += [(100, "\n" * 40 + "x"), (101, "y" + "\n" * 40 + "x"), (102, "x" + "\n" * 9), (103, "x" + "\n" * 9), rows[3], (3, "a\nb"), (None, rows[4][1])]
    rows += [(i, "ten chars.\nten more..\nand more..\nlast " + str(i)) for i in (200, 201)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {}
    for x in line_dedup.repeated_runs(df, min_chars).collect():
        got.setdefault((x.doc_id, x.text_key), set()).update(range(x.start_line, x.start_line + x.n_lines))
    assert got == brute.gone_lines(listed(df), min_chars)
    assert bag(listed(line_dedup.line_dedup(df, min_chars))) == bag([{k: v for k, v in d.items() if k != "n_chars"} for d in brute.line_dedup(listed(df), min_chars)])


def test_line_runs_tell_the_lines(docs):
    got = {}
    for r in line_dedup.repeated_runs(docs).collect():
        got.setdefault((r.doc_id, r.text_key), set()).update(range(r.start_line, r.start_line + r.n_lines))
    assert got == brute.gone_lines(listed(docs))


def test_similar_pairs_at_any_depth(spark):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, 80, dtype=np.uint64)
    v = np.concatenate([base, base[:20]] + [base ^ np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 12), replace=False)) for _ in base], np.uint64) for _ in range(4)] + [np.repeat(base[:1], 30)])
    df = spark.createDataFrame([(i, int(x.astype(np.int64))) for i, x in enumerate(v)], "node bigint, fp bigint")
    near = np.bitwise_count(v[:, None] ^ v[None, :])
    for budget in (3, 8):
        want = {(i, j): int(near[i, j]) for i in range(len(v)) for j in range(i + 1, len(v)) if near[i, j] <= budget}
        for rows in (100_000, 2, 1):  # no, some, and all further bits; prefixes cut into parts
            got = simhash_trie.similar_pairs(df, budget, task_rows=rows).collect()
            assert {(r.a, r.b): r.distance for r in got} == want and len(got) == len(want)
        forest = simhash_trie.similar_pairs(df, budget, forest=True, task_rows=2).collect()
        assert _class_of(len(v), [(r.a, r.b) for r in forest]) == _class_of(len(v), want)


def test_equal_word_prints_need_equal_runs(spark):
    rows = [(0, "la la la no"), (1, "la la la si"), (2, "la la la no"), (3, "no la la la")]
    got = {r.doc_id: r.keep_doc_id for r in simhash_trie.duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    want = brute.groups([{"doc_id": i, "key": i, "text": t} for i, t in rows])
    assert got == {a[0]: b[0] for a, b in want.items() if a != b} and 1 not in got


def test_near_dedup(docs):
    rows = listed(docs)
    assert bag(listed(simhash_trie.near_dedup(docs))) == bag(brute.near_dedup(rows))
    keep = brute.groups(rows)
    got = {(r.doc_id, r.text_key): (r.keep_doc_id, r.keep_text_key) for r in simhash_trie.duplicates(docs).collect()}
    assert got == {a: b for a, b in keep.items() if a != b}
    assert {30, 31} <= {a for a, _ in got}


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a bigint, b bigint")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}



def test_components_of_few_edges_take_no_rounds(spark):
    ids = random.Random(6).sample(range(-(10**12), 10**12), 60)
    links = list(zip(ids[:40], ids[1:41])) + [(x, ids[50]) for x in ids[51:]] + [(7, 7), (ids[1], ids[0])]
    folder = pathlib.Path(shared_dir(spark).removeprefix("file:"))
    for rows in ([], links):
        edges = spark.createDataFrame(rows, "a bigint, b bigint")
        was = len(list(folder.glob("tarnwood-stars-*")))
        few = {r.node: r.root for r in components(edges).collect()}
        assert len(list(folder.glob("tarnwood-stars-*"))) == was
        assert few == {r.node: r.root for r in components(edges, task_edges=-1).collect()}
        assert len(list(folder.glob("tarnwood-stars-*"))) > was
    assert {few[x] for x in ids[:41]} == {min(ids[:41])} and few[7] == 7 and few[ids[51]] == min(ids[50:])


def test_components_in_any_order(spark):
    ids = random.Random(5).sample(range(-(10**12), 10**12), 120)
    rows = list(zip(ids[:80], ids[1:81])) + [(x, ids[90]) for x in ids[91:]] + [(7, 7), (ids[0], ids[0]), (ids[1], ids[0])]
    out = components(spark.createDataFrame(rows, "a bigint, b bigint"))
    # a size estimate whose digits double each round fills the driver
    assert out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 40
    got = [(r.node, r.root) for r in out.collect()]
    assert sorted(got) == sorted([(x, min(ids[:81])) for x in ids[:81]] + [(x, min(ids[90:])) for x in ids[90:]] + [(7, 7)])


def test_mix(docs):
    assert bag(listed(mixing.mix(docs, keep=True, block_docs=4))) == bag(brute.mix(listed(docs), block_docs=4))
    tokens = {r.source: r.t for r in mixing.mix(docs, max_repeats=None, budget=3000, block_docs=4).groupBy("source").agg(F.sum("tokens").alias("t")).collect()}
    assert all(t >= 700 for s, t in tokens.items() if s is not None)


@pytest.mark.parametrize("window", [16, 2048])
def test_pack(docs, window):
    rows = [d for d in listed(docs) if (d["text"] or "").split()]
    out = packing.pack(docs, window=window, shard_docs=10**6, with_text=True).orderBy("shard", "window").collect()
    assert all(r.n_tokens <= window and r.n_tokens + r.padding == window for r in out)
    whole = {}
    for r in out:
        for i, a, b in zip(r.doc_ids, r.starts, r.ends):
            whole.setdefault((r.shard, i), []).append((a, b))
    once = [d for d in rows if d["doc_id"] not in (5, None)]
    for d in once:
        spans, raw = whole[0, d["doc_id"]], d["text"].encode()
        assert spans[0][0] == 0 and spans[-1][1] == len(raw) and all(x[1] == y[0] for x, y in zip(spans, spans[1:]))
    ends = packing.units
    import pyarrow as pa

    first = sorted(rows, key=brute.order)
    _, tokens, _, kind = ends(pa.array([d["text"] for d in first]), window)
    fine = np.array([0, 64, 512])[kind]
    at = {int(x): f for x, f in zip(np.cumsum(tokens), fine)}
    own, cost, used = [r for r in out if r.shard == 0], 0.0, 0
    for n, r in enumerate(own):
        used += r.n_tokens
        cost += r.padding + (at[used] if n < len(own) - 1 else 0)
    assert cost == brute.packing_cost(first, window)


def test_language_id(docs):
    model = brute.trained(docs)
    kept = listed(ppm_langid.identify(docs, keep=True))
    assert bag(kept) == bag(brute.language_id(listed(docs), model))
    ids = {d["doc_id"] for d in kept}
    assert ids >= set(range(24)) and not ids & {40, 42, 43}
    right = [r.lang == r.predicted for r in ppm_langid.identify(docs).where("doc_id < 24 and lang is not null").collect()]
    assert np.mean(right) > 0.95


def test_language_id_held_out(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    even, odd = d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1")
    model = ppm_langid.train(ppm_langid.training_rows(even, 160, 6_000))
    got = ppm_langid.identify(odd, model=model).where("accepted").collect()
    assert len(got) > 0.85 * odd.count() and np.mean([r.lang == r.predicted for r in got]) > 0.95


# passages, vectors, fingerprints, fixity, personal data


def test_passages(docs):
    got = {}
    for r in suffix_index.repeated_passages(docs, length=30, gram=5, batches=3).collect():
        got.setdefault(r.doc_id, set()).update(range(r.start_word, r.start_word + r.n_words))
    want = {}
    for (d, _), s in brute.passages(listed(docs), 30).items():
        want.setdefault(d, set()).update(s)
    assert got == want and {36, 37} <= set(got)


def test_passages_of_hot_prefixes(docs, monkeypatch):
    whole = suffix_index.repeated_passages(docs, length=30, gram=5).collect()
    monkeypatch.setattr(suffix_index, "GROUP_ROWS", 1)  # windows of every prefix are spread
    assert sorted(map(str, suffix_index.repeated_passages(docs, length=30, gram=5).collect())) == sorted(map(str, whole))


def test_suffix_family_grows_in_its_folder(spark, tmp_path):
    r = random.Random(2)
    rows = [(r.randrange(40), r.randrange(3), t, r.randrange(9)) for t in range(5) for _ in range(30 + 17 * t)]
    schema, path = "k1 bigint, k2 bigint, text_key bigint, pos int", f"file://{tmp_path}/family"
    for t in (0, 3, 1, 4, 2):
        index = suffix_index.SuffixIndex(spark, path, buckets=3)  # opened anew for each batch
        index.add(spark.createDataFrame([x for x in rows if x[2] == t], schema))
    index = suffix_index.SuffixIndex(spark, path)
    assert [n for n, _ in index.levels] == [4, 1] and index.buckets == 3
    texts, every = {}, set(rows)
    for k1, k2, t, _ in every:
        texts.setdefault((k1, k2), set()).add(t)
    want = {x: sum(y[:2] == x[:2] for y in every) for x in every if len(texts[x[:2]]) > 1}
    assert {(x.k1, x.k2, x.text_key, x.pos): x.n for x in index.common().collect()} == want
    level = index._table(index.levels[0][1])
    merged = index._table(index.levels[1][1]).join(level, ["k1", "k2"])
    assert "Exchange hashpartitioning" not in merged._jdf.queryExecution().executedPlan().toString()  # levels are merged without a shuffle
    index.close()
    assert suffix_index.SuffixIndex(spark, path).levels == []


def _class_of(n, edges):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in edges:
        x, y = find(i), find(j)
        root[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("cell_rows", [4096, 7])
def test_similar_vectors(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(e8, "CELL_ROWS", cell_rows)
    rng = np.random.default_rng(9)
    base = rng.standard_normal((150, 64))
    v = np.concatenate([base, base[:100] + rng.standard_normal((100, 64)) * 0.15, base[149] + rng.standard_normal((40, 64)) * 0.1])
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    rows += [(900, None), (901, []), (902, [0.0] * 64), (903, [float("nan")] * 64), (None, rows[0][1]), rows[3], (904, [1.0, 2.0]), (905, rows[7][1]), (906, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {r.vec_id: r for r in e8.similar_vectors(clashing(df)).collect()}
    assert set(got) == set(range(len(v))) | {904, 905, 906}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = (u @ u.T >= 0.95) & ~np.eye(len(v), dtype=bool)
    links = np.array([got[i].links for i in range(len(v))])
    assert (links <= near.sum(1)).all() and links.sum() >= 0.95 * near.sum() > 1000  # recall
    of = _class_of(len(v), np.argwhere(near))
    assert np.mean([got[i].class_id == of[i] for i in range(len(v))]) > 0.95
    assert [(got[i].copies, got[i].class_id) for i in (7, 905, 906)] == [(2, got[7].class_id)] * 3 and got[904].links == got[904].copies == 0
    assert e8.similar_vectors(df.limit(0)).count() == 0


def test_similar_vectors_recall_at_the_threshold(spark):
    rng = np.random.default_rng(3)
    a = rng.standard_normal((1000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    z = rng.standard_normal((1000, 64))
    z -= (z * a).sum(1, keepdims=True) * a
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    b = 0.951 * a + np.sqrt(1 - 0.951**2) * z
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(np.concatenate([a, b]))], "vec_id bigint, embedding array<double>")
    assert e8.similar_vectors(df).where("links > 0").count() >= 0.95 * 2000


def test_fingerprints_against_all_pairs(docs):
    rows = {(r.doc_id, r.signature): r for r in ctph.fingerprints(docs).collect()}
    sign = list({(r.block_size, r.signature, r.signature2) for r in rows.values() if r.block_size})
    head = {}
    for r in sorted(rows.values(), key=lambda r: (r.doc_id is None, r.doc_id or 0)):
        head.setdefault((r.block_size, r.signature, r.signature2), r.doc_id)
    for r in rows.values():
        own = (r.block_size, r.signature, r.signature2)
        if not r.block_size:
            assert r.like_doc_id is None and r.score == 0 and r.signature == ""
            continue
        if head[own] != r.doc_id:
            assert (r.like_doc_id, r.score) == (head[own], 100)
            continue
        best = 0
        for o in sign:
            if o != own:
                for x, y in [(own[1], o[1]), (own[2], o[2])] * (own[0] == o[0]) + [(own[1], o[2])] * (own[0] == 2 * o[0]) + [(own[2], o[1])] * (o[0] == 2 * own[0]):
                    x, y = ctph.squeeze(x), ctph.squeeze(y)
                    if {x[i : i + 7] for i in range(len(x) - 6)} & {y[i : i + 7] for i in range(len(y) - 6)}:
                        best = max(best, int(ctph.similarity([x], [y])[0]))
        assert r.score == (best if best >= 60 else 0)
    assert next(r for r in rows.values() if r.doc_id == 30).score == 100


def _scores(sign):
    """{(a, b): best score} of all pairs of (block_size, signature, signature2) that share seven characters at one block size."""
    out = {}
    for a in sign:
        for b in sign - {a}:
            both = [(a[1], b[1]), (a[2], b[2])] * (a[0] == b[0]) + [(a[1], b[2])] * (a[0] == 2 * b[0]) + [(a[2], b[1])] * (b[0] == 2 * a[0])
            both = [(ctph.squeeze(x), ctph.squeeze(y)) for x, y in both]
            if any({x[i : i + 7] for i in range(len(x) - 6)} & {y[i : i + 7] for i in range(len(y) - 6)} for x, y in both):
                out[a, b] = max(int(ctph.similarity([x], [y])[0]) for x, y in both)
    return out


@pytest.mark.parametrize("gram_rows", [2000, 3])
def test_fingerprints_link_all_pairs(spark, monkeypatch, gram_rows):
    monkeypatch.setattr(ctph, "GRAM_ROWS", gram_rows)
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 8)))
    rows = []
    for base in range(2):
        words = [word() for _ in range(400)]
        for k in range(6):  # a chain: each differs more from the first
            rows.append((10 * base + k, " ".join(words)))
            for _ in range(6):
                words[r.randrange(400)] = word()
    rows += [(50, rows[0][1]), (None, rows[1][1] + " and more"), (60, "")]
    got = ctph.fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()
    sign = {x.group: (x.block_size, x.signature, x.signature2) for x in got if x.group is not None}
    want = {k: v for k, v in _scores(set(sign.values())).items() if v >= 60}
    head = {g: min((x.doc_id is None, x.doc_id or 0) for x in got if x.group == g) for g in sign}
    groups = sorted(sign)
    of = _class_of(len(groups), [(groups.index(g), groups.index(h)) for g in groups for h in groups if (sign[g], sign[h]) in want])
    for x in got:
        if x.group is not None:
            own = {h: want[sign[x.group], sign[h]] for h in sign if (sign[x.group], sign[h]) in want}
            assert x.links == len(own)
            assert (x.class_id is None, x.class_id or 0) == min(head[h] for h, c in zip(groups, of) if c == of[groups.index(x.group)])
            if (x.doc_id is None, x.doc_id or 0) == head[x.group] and own:
                best = min((-v, head[h]) for h, v in own.items())
                assert (x.score, (x.like_doc_id is None, x.like_doc_id or 0)) == (-best[0], best[1])
    assert max(x.links for x in got) > 3
    by = {x.doc_id: x for x in got}
    assert by[50].group == by[0].group and by[50].links == by[0].links and by[50].like_doc_id == 0
    assert (by[60].group, by[60].class_id, by[60].links) == (None, None, 0)


def test_fingerprints_of_short_texts(spark):
    short = [f"{a}{b}" for a in "abcdefghijklmn" for b in "opqrstuvwxyz"]  # more than the 64 signatures
    r = random.Random(8)
    base = "".join(r.choice("abcdefghij ") for _ in range(150))
    near = [base] + [base[:p] + c + base[p + 1 : q] + d + base[q + 1 :] for p, c, q, d in ((r.randrange(70), r.choice("klmnop"), r.randrange(75, 150), r.choice("klmnop")) for _ in range(20_000))]
    first = {}
    signs = zip(*(list(x) for x in ctph.signatures(pa.array(near))))
    a, b = next((first[x], t) for t, x in zip(near, signs) if len(x[1]) >= 7 and first.setdefault(x, t) != t)
    rows = [*enumerate(short), (1000, short[100]), (1001, short[100]), (2000, a), (2001, b), (2002, b)]
    got = {x.doc_id: x for x in ctph.fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()}
    assert len({(x.block_size, x.signature, x.signature2) for x in got.values()}) < len(short)
    assert all((got[i].like_doc_id, got[i].score, got[i].links) == (None, 0, 0) for i in range(len(short)))
    assert [(got[i].like_doc_id, got[i].score) for i in (1000, 1001)] == [(100, 100)] * 2
    assert [(got[i].like_doc_id, got[i].score) for i in (2000, 2001, 2002)] == [(2001, 100), (2000, 100), (2001, 100)]


def test_merkle(spark):
    rows = [(i, f"u{i}", f"text {i}") for i in range(3000)] + [(None, "n", None), (7, "again", "")]
    a = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    b = a.where("page_id is null or page_id <> 100").withColumn("html", F.when(F.col("page_id") == 2000, "bad").otherwise(F.col("html")))
    b = b.union(spark.createDataFrame([(5000, "new", "x")], b.schema))
    found = merkle.audit(a, b, fanout=8).collect()
    assert {(r.key, r.status) for r in found if r.level == 0} == {(100, "lost"), (2000, "differs"), (5000, "extra")}
    top = max(r.level for r in found)
    assert [r.status for r in found if r.level == top] == ["differs"] and len(found) <= 3 * (top + 1)
    assert merkle.audit(a, a.repartition(5)).isEmpty()
    assert merkle.audit(a.limit(0), a.limit(0)).isEmpty()
    assert {r.status for r in merkle.audit(a, a.limit(0)).where("level = 0").collect()} == {"lost"}
    twice = merkle.audit(a, a.union(a.where("page_id = 3"))).where("level = 0").collect()
    assert [(r.key, r.status) for r in twice] == [(3, "differs")]
    gap = merkle.audit(a, a.withColumn("html", F.coalesce("html", F.lit("")))).where("level = 0").collect()
    assert [(r.key, r.status) for r in gap] == [(None, "differs")]  # null isn't empty


def test_merkle_of_odd_keys_and_columns(spark):
    schema = "`record.id` string, url string, html string"
    a = spark.createDataFrame([(f"<urn:{i}>", f"u{i}", "x" * i) for i in range(200)] + [("<urn:7>", "again", None), (None, "a\x1f1b", "c"), ("long", "u", "y" * 3_000_000)], schema)
    b = a.where("`record.id` is null or `record.id` <> '<urn:9>'").withColumn("url", F.when(F.col("`record.id`") == "<urn:50>", "bad").otherwise(F.col("url")))
    b = b.withColumn("html", F.when(F.col("`record.id`") == "long", F.concat(F.substring("html", 2, 10**7), F.lit("z"))).otherwise(F.col("html")))
    found = merkle.audit(clashing(a), clashing(b), "record.id", ["url", "html"]).where("level = 0").collect()
    assert {(r.key, r.status) for r in found} == {("<urn:9>", "lost"), ("<urn:50>", "differs"), ("long", "differs")}
    # no other row of fields reads the same
    b = a.withColumn("html", F.when(F.col("`record.id`").isNull(), "b\x1f1c").otherwise(F.col("html"))).withColumn("url", F.when(F.col("`record.id`").isNull(), "a").otherwise(F.col("url")))
    assert [(r.key, r.status) for r in merkle.audit(a, b, "record.id", ["url", "html"]).where("level = 0").collect()] == [(None, "differs")]
    far = spark.createDataFrame([(-(2**62), "a"), (2**62, "b")], "page_id bigint, url string")
    assert [(r.key, r.status) for r in merkle.audit(far, far.where("page_id < 0")).where("level = 0").collect()] == [(str(2**62), "lost")]


@pytest.mark.parametrize("beginnings", [1_000_000, 2])
def test_pack_shards_by_rank(spark, monkeypatch, beginnings):
    monkeypatch.setattr(packing, "BEGINNINGS", beginnings)
    ids = [*range(100), 10**12, 10**15, *[None] * 30, *[7] * 25]
    df = spark.createDataFrame([(i, f"a b c {n % 5 if i is None else i}") for n, i in enumerate(ids)], "doc_id bigint, text string").repartition(3)
    out = packing.pack(df, window=16, shard_docs=10).collect()
    held = {}
    for r in out:
        held.setdefault(r.shard, []).extend(dict.fromkeys(r.doc_ids) if None not in r.doc_ids and 7 not in r.doc_ids else r.doc_ids)
    assert sum(r.n_tokens for r in out) == 4 * len(ids) and max(map(len, held.values())) <= 25
    lone = [sorted(x) for s, x in sorted(held.items()) if None not in x and 7 not in x]
    assert lone == sorted(lone) and sorted(i for x in lone for i in x) == sum(lone, [])


def test_entities(spark):
    text = "write to jo.doe@mail.example.com or +1 (555) 123-4567 by 2024-01-02"
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (None, text), (4, "no digits"), (5, "word " * 60_000 + text)], "doc_id bigint, text string")
    got = {}
    for r in pii_crf.entities(clashing(df)).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.end, r.type))
    assert set(got) == {1, 5, None}
    assert [(text[a:b], k) for a, b, k in sorted(got[1])] == [("jo.doe@mail.example.com", "EMAIL"), ("+1 (555) 123-4567", "PHONE")] and sorted(got[1]) == sorted(got[None])
    assert sorted(got[5]) == sorted((a + 300_000, b + 300_000, k) for a, b, k in got[1])


# odd tables


def _operators():
    return {
        "lines": line_dedup.line_dedup, "runs": line_dedup.repeated_runs, "near": simhash_trie.near_dedup, "duplicates": simhash_trie.duplicates, "mix": mixing.mix, "mixed": lambda d: mixing.mix(d, keep=True),
        "pack": packing.pack, "lang": ppm_langid.identify, "kept": lambda d: ppm_langid.identify(d, keep=True), "passages": suffix_index.repeated_passages, "ctph": ctph.fingerprints, "pii": pii_crf.entities,
    }


@pytest.mark.parametrize("name", list(_operators()))
def test_empty_table(empty, name):
    assert _operators()[name](empty).count() == 0


@pytest.mark.parametrize("name", list(_operators()))
def test_clashing_columns_change_nothing(docs, name):
    run = _operators()[name]
    plain, odd = run(docs), run(clashing(docs))
    assert sorted(map(str, odd.select(plain.columns).collect())) == sorted(map(str, plain.collect()))


# the pipeline


def test_pipeline_stages_against_slow_versions(spark, docs, tmp_path):
    at = str(tmp_path)
    docs.write.parquet(f"{at}/documents.parquet")
    slow = {"language_id": lambda r, d: brute.language_id(r, brute.trained(d)), "line_dedup": lambda r, d: brute.line_dedup(r), "simhash_near_dedup": lambda r, d: brute.near_dedup(r), "temperature_mix": lambda r, d: brute.mix(r)}
    now = spark.read.parquet(f"{at}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, at)
        assert out.columns == docs.columns
        assert bag(listed(out)) == bag(slow[name](listed(now), now)), name
        out.write.parquet(f"{at}/{name}")
        now = spark.read.parquet(f"{at}/{name}")
    last = corpus_pipeline.STAGES[-1][1](spark, now, at)
    got = corpus_pipeline.run(spark, at)
    assert sorted(map(str, got.collect())) == sorted(map(str, last.collect()))
    assert sum(r.n_tokens for r in got.collect()) == sum(len((d["text"] or "").split()) for d in listed(now))


def test_pipeline_of_an_empty_table(spark, empty, tmp_path):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

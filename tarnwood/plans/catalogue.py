"""The engine's registered queries, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.params import METHODS, RankParams
from ..functions.scoring import rounded
from ..functions.stopwords import stopword_list
from ..functions.text import tokenize
from ..operators import index as ix
from ..operators import lexicon as lx
from ..operators import retrieve as rt
from ..operators.metrics import evaluate, judged_queries
from ..operators.staging import fresh_path
from ..sources.loaders import prefix_union
from ..streaming import text_streams as ts

Query = Callable[[SparkSession, str], DataFrame]
SLUG = {m: m.replace("+", "plus") for m in METHODS}
K = 10


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "documents").select("doc_id", "text")


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    return tokenize(_docs(spark, d))


def _index(spark: SparkSession, d: str, params: RankParams | None = None) -> ix.Index:
    return ix.build_index(_docs(spark, d), params, payload=False)


def _passages(spark: SparkSession, d: str) -> DataFrame:
    """The benchmark passages as a batch of queries."""
    return tokenize(_read(spark, d, "benchmark"), id_col="item_id").withColumnRenamed("doc_id", "query_id")


def _names(spark: SparkSession, d: str) -> DataFrame:
    """Queries of one known word and one that no document has."""
    text = F.concat(F.when(F.col("n_nationkey") % 2 == 0, F.lit("the")).otherwise(F.col("n_name")), F.lit(" zzunheardof"))
    asked = _read(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("query_id"), text.alias("text"))
    return tokenize(asked, id_col="query_id").withColumnRenamed("doc_id", "query_id")


def _score(c: str = "score") -> Column:
    return rounded(c, 4).alias(c)


def _best(results: DataFrame) -> DataFrame:
    return results.select("query_id", "rank", "doc_id", _score())


def _mask(spark: SparkSession, d: str) -> DataFrame:
    """Toxic documents count nothing, those of low quality half."""
    weight = F.when(F.col("toxic") == 1, 0.0).when(F.col("quality") == 0, 0.5).otherwise(1.0)
    return _read(spark, d, "labels").select("doc_id", weight.alias("weight"))


def _qrels(spark: SparkSession, d: str) -> DataFrame:
    """Judgements: every labelled document, for every passage, by its quality."""
    return _read(spark, d, "benchmark").select(F.col("item_id").alias("query_id")).crossJoin(_read(spark, d, "labels").select("doc_id", F.col("quality").alias("rel")))


def tokenize_docs(spark, d):
    return _tokens(spark, d).select("doc_id", F.size("terms").cast("bigint").alias("n_terms"), F.array_join("terms", " ").alias("terms"))


def tokenize_stopwords(spark, d):
    t = tokenize(_docs(spark, d), stopwords="en")
    return t.select("doc_id", F.size("terms").cast("bigint").alias("n_terms"), F.array_join("terms", " ").alias("terms"))


def empty_doc_policy(spark, d):
    keep = tokenize(_docs(spark, d), pattern=r"[0-9]{4,}")
    fill = tokenize(_docs(spark, d), pattern=r"[0-9]{4,}", empty="empty_token")
    both = keep.select("doc_id", F.lit("keep_empty").alias("policy"), "terms").union(fill.select("doc_id", F.lit("empty_token"), "terms"))
    return both.select("doc_id", "policy", F.size("terms").cast("bigint").alias("n_terms"))


def vocab_first_seen(spark, d):
    return lx.first_seen(_tokens(spark, d))


def encode_ids(spark, d):
    t = lx.chunked(_tokens(spark, d))
    return lx.encode(t, lx.first_seen(t)).select("doc_id", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


def decode_ids(spark, d):
    t = lx.chunked(_tokens(spark, d))
    vocab = lx.sorted_ids(t)
    return lx.decode(lx.encode(t, vocab), vocab).select("doc_id", F.size("terms").cast("bigint").alias("n_terms"), F.array_join("terms", " ").alias("terms"))


def tokenizer_never(spark, d):
    tok = lx.Tokenizer(spark, stopwords="en")
    tok.tokenize(_docs(spark, d), update=True)
    return tok.tokenize(_read(spark, d, "pages"), "html", "page_id", update="never").select("doc_id", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


def term_frequency(spark, d):
    return ix.term_frequencies(_tokens(spark, d))


def doc_length_stats(spark, d):
    return ix.corpus_stats(ix.document_lengths(_tokens(spark, d))).select("n_docs", F.round("avgdl", 6).alias("avgdl"), "n_tokens")


def doc_frequency(spark, d):
    return ix.document_frequencies(ix.term_frequencies(_tokens(spark, d)))


def _idf(method: str) -> Query:
    return lambda spark, d: _index(spark, d, RankParams(method=method)).vocab.select("term", "df", F.round("idf", 6).alias("idf"))


def _postings(method: str) -> Query:
    return lambda spark, d: _index(spark, d, RankParams(method=method)).postings.select("term", "doc_id", "tf", rounded("score", 6).alias("score"))


def _nonoccurrence(method: str) -> Query:
    return lambda spark, d: _index(spark, d, RankParams(method=method)).vocab.select("term", F.round("nonocc", 6).alias("nonocc"))


def _retrieve(params: RankParams) -> Query:
    return lambda spark, d: _best(rt.retrieve(_index(spark, d, params), _passages(spark, d), K))


def score_all_docs(spark, d):
    return rt.score_all(_index(spark, d, RankParams(method="bm25l")), _passages(spark, d)).select("query_id", "doc_id", _score())


def _masked(mode: str) -> Query:
    return lambda spark, d: _best(rt.retrieve(_index(spark, d, RankParams(method="bm25+")), _passages(spark, d), K, _mask(spark, d), mode))


def retrieve_zero_fill(spark, d):
    return _best(rt.retrieve(_index(spark, d), _names(spark, d), K))


def retrieve_hits_only(spark, d):
    return _best(rt.retrieve(_index(spark, d), _names(spark, d), K, fill=False))


def retrieve_turns(spark, d):
    turns = _read(spark, d, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text")
    terms = tokenize(turns, id_col="query_id").withColumnRenamed("doc_id", "query_id")
    return _best(rt.retrieve(_index(spark, d), terms, K))


def retrieve_batch_payload(spark, d):
    index = ix.build_index(_read(spark, d, "documents").select("doc_id", "text", "lang", "source"))
    return rt.retrieve(index, _passages(spark, d), K, payload=True).select("query_id", "rank", "doc_id", _score(), "lang", "source")


def merge_results(spark, d):
    index = _index(spark, d)
    names = rt.retrieve(index, _names(spark, d), K).withColumn("query_id", F.col("query_id") + 1_000_000)
    return _best(rt.merge_results([rt.retrieve(index, _passages(spark, d), K), names]))


def merge_corpora_prefix(spark, d):
    both = prefix_union({"documents": _docs(spark, d), "pages": _read(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))})
    return tokenize(both).select("doc_id", F.size("terms").cast("bigint").alias("n_terms"))


def index_stats(spark, d):
    s = _index(spark, d).describe()
    return s.select("n_docs", "n_terms", "n_postings", F.round("postings_per_doc", 6).alias("postings_per_doc"), F.round("avgdl", 6).alias("avgdl"))


def csc_indptr(spark, d):
    return _index(spark, d).offsets()


def metrics_at_k(spark, d):
    return evaluate(_qrels(spark, d), rt.retrieve(_index(spark, d), _passages(spark, d), K), (1, 3, 5, 10), ignore_identical_ids=True)


def semi_join_qrels(spark, d):
    asked = _read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return judged_queries(asked, _read(spark, d, "labels").select(F.col("doc_id").alias("query_id")))


def stem_docs(spark, d):
    t = tokenize(_docs(spark, d), stopwords="en", stemmer="english")
    return t.select("doc_id", F.size("terms").cast("bigint").alias("n_terms"), F.array_join("terms", " ").alias("terms"))


def save_load_roundtrip(spark, d):
    at = fresh_path(spark, "index")
    _index(spark, d, RankParams(method="atire")).save(at)
    return _best(rt.retrieve(ix.load_index(spark, at), _passages(spark, d), K))


def rescore_loaded(spark, d):
    at = fresh_path(spark, "index")
    _index(spark, d, RankParams(method="atire")).save(at)
    return _best(rt.retrieve(ix.load_index(spark, at, method="bm25l"), _passages(spark, d), K))


def index_append(spark, d):
    docs = _read(spark, d, "documents").select("doc_id", "text", "lang")
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    grown = ix.build_index(docs.where(english), RankParams(method="robertson")).append(docs.where(~english))
    return _best(rt.retrieve(grown, _passages(spark, d), K))


def stream_tokenize(spark, d):
    out = ts.drain(ts.stream_tokens(ts.read_documents(spark, f"{d}/documents.parquet")), "stream-tokens")
    return out.select("doc_id", F.size("terms").cast("bigint").alias("n_terms"), F.array_join("terms", " ").alias("terms"))


def stream_doc_freq(spark, d):
    return ts.drain(ts.stream_term_counts(ts.read_documents(spark, f"{d}/documents.parquet")), "stream-df", "complete").select("term", "df", "tf")


def stream_windows(spark, d):
    out = ts.drain(ts.windowed_counts(ts.read_documents(spark, f"{d}/events.parquet"), "ts", "event_type", "6 hours"), "stream-windows", "complete")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "key", "n")


def stream_ingest(spark, d):
    at = fresh_path(spark, "ingest")
    ts.ingest(ts.read_documents(spark, f"{d}/documents.parquet"), at, f"{at}-progress").awaitTermination()
    return _best(rt.retrieve(ts.open_ingested(spark, at), _passages(spark, d), K))


def queries() -> dict[str, Query]:
    plain = (tokenize_docs, tokenize_stopwords, empty_doc_policy, vocab_first_seen, encode_ids, decode_ids, tokenizer_never, term_frequency, doc_length_stats, doc_frequency, score_all_docs, retrieve_zero_fill, retrieve_hits_only, retrieve_turns, retrieve_batch_payload, merge_results, merge_corpora_prefix, index_stats, csc_indptr, metrics_at_k, semi_join_qrels, stem_docs, save_load_roundtrip, rescore_loaded, index_append, stream_tokenize, stream_doc_freq, stream_windows, stream_ingest)
    out: dict[str, Query] = {q.__name__: q for q in plain}
    for m in METHODS:
        out |= {f"idf_{SLUG[m]}": _idf(m), f"postings_{SLUG[m]}": _postings(m), f"retrieve_{SLUG[m]}": _retrieve(RankParams(method=m))}
    out |= {f"nonoccurrence_{SLUG[m]}": _nonoccurrence(m) for m in ("bm25l", "bm25+")}
    out["retrieve_mixed_idf"] = _retrieve(RankParams(method="atire", idf_method="lucene"))
    return out | {f"retrieve_masked_{m}": _masked(m) for m in ("pre", "post")}


# SQL: parts of one WITH clause

_SPLIT = "regexp_extract_all(lower(coalesce({}, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}')"
_TF = {
    "robertson": "tf / (1.5 * nl + tf)",
    "lucene": "tf / (1.5 * nl + tf)",
    "atire": "tf * 2.5 / (tf + 1.5 * nl)",
    "bm25l": "2.5 * (tf / nl + 0.5) / (1.5 + tf / nl + 0.5)",
    "bm25+": "2.5 * tf / (1.5 * nl + tf) + 0.5",
}
_IDF = {
    "robertson": "ln(greatest(1.0, (n - df + 0.5) / (df + 0.5)))",
    "lucene": "ln(1 + (n - df + 0.5) / (df + 0.5))",
    "atire": "ln(n / df)",
    "bm25l": "ln((n + 1) / (df + 0.5))",
    "bm25+": "ln((n + 1) / df)",
}
_ABSENT = {"bm25l": "1.25 / 2.0", "bm25+": "0.5"}


def _stopped(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _corpus_sql(method: str = "lucene", idf: str | None = None) -> str:
    """CTEs: tok, len, st, tf, vo and po."""
    return f"""
tok AS MATERIALIZED (SELECT doc_id, {_SPLIT.format("text")} AS terms FROM documents),
len AS (SELECT doc_id, len(terms) AS dl FROM tok),
st AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(dl) AS a FROM len),
tf AS MATERIALIZED (SELECT term, doc_id, CAST(count(*) AS DOUBLE) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM tok) GROUP BY ALL),
vo AS MATERIALIZED (SELECT term, df, idf, idf * ({_ABSENT.get(method, "0.0")}) AS nonocc FROM (SELECT term, df, {_IDF[idf or method]} AS idf FROM (SELECT term, CAST(count(*) AS DOUBLE) AS df FROM tf GROUP BY term), st)),
po AS MATERIALIZED (SELECT term, doc_id, tf, idf * ({_TF[method]}) - nonocc AS score FROM (SELECT *, 0.25 + 0.75 * dl / a AS nl FROM tf JOIN len USING (doc_id) JOIN vo USING (term), st))"""


_PASSAGES = f"SELECT item_id AS query_id, {_SPLIT.format('text')} AS terms FROM benchmark"
_NAMES = f"SELECT CAST(n_nationkey AS BIGINT) AS query_id, {_SPLIT.format('w')} AS terms FROM (SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'the' ELSE n_name END || ' zzunheardof' AS w FROM nation)"
_TURNS = f"SELECT conv_id * 1000 + turn AS query_id, {_SPLIT.format('text')} AS terms FROM conversations WHERE role = 'user'"
_MASK_SQL = "SELECT doc_id, CASE WHEN toxic = 1 THEN 0.0 WHEN quality = 0 THEN 0.5 ELSE 1.0 END AS w FROM labels"


def _dense_sql(queries: str, total: str = "s * w + c", mask: str = "SELECT CAST(NULL AS BIGINT) AS doc_id, 1.0 AS w WHERE false") -> str:
    """CTEs: dense(query_id, doc_id, score) of every pair, hit telling those with a score of their own."""
    return f"""
q0 AS MATERIALIZED ({queries}),
q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(terms) AS term FROM q0) GROUP BY ALL),
h AS MATERIALIZED (SELECT query_id, doc_id, sum(score * qtf) AS s FROM q JOIN po USING (term) GROUP BY ALL),
co AS (SELECT query_id, sum(nonocc * qtf) AS c FROM q JOIN vo USING (term) GROUP BY ALL),
mk AS ({mask}),
dense AS (SELECT query_id, doc_id, round({total}, 9) AS score, s <> 0 AS hit FROM (
  SELECT q0.query_id, len.doc_id, coalesce(s, 0.0) AS s, coalesce(c, 0.0) AS c, coalesce(w, 1.0) AS w
  FROM q0 CROSS JOIN len LEFT JOIN h ON h.query_id = q0.query_id AND h.doc_id = len.doc_id LEFT JOIN co ON co.query_id = q0.query_id LEFT JOIN mk ON mk.doc_id = len.doc_id)),
top AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM dense QUALIFY rank <= {K})"""


_TOP = "SELECT query_id, rank, doc_id, round(score, 4) AS score FROM top"


def _retrieve_sql(method: str = "lucene", idf: str | None = None, asked: str = _PASSAGES, **dense: str) -> str:
    return f"WITH {_corpus_sql(method, idf)},{_dense_sql(asked, **dense)}\n{_TOP}"


def _metrics_sql() -> str:
    parts = ", ".join(
        f"avg(CASE WHEN i{k} > 0 THEN d{k} / i{k} ELSE 0 END) AS ndcg{k}, avg(CASE WHEN n > 0 THEN a{k} / n ELSE 0 END) AS map{k}, avg(CASE WHEN n > 0 THEN h{k} / n ELSE 0 END) AS recall{k}, avg(h{k} / {k}.0) AS p{k}" for k in (1, 3, 5, 10)
    )
    per = ", ".join(f"sum(CASE WHEN r <= {k} THEN rel / log2(r + 1) ELSE 0 END) AS d{k}, sum(CASE WHEN r <= {k} THEN rel ELSE 0 END) AS h{k}, sum(CASE WHEN r <= {k} THEN rel * p ELSE 0 END) AS a{k}" for k in (1, 3, 5, 10))
    ideal = ", ".join(f"sum(CASE WHEN i <= {k} THEN 1 / log2(i + 1) ELSE 0 END) AS i{k}" for k in (1, 3, 5, 10))
    rows = " UNION ALL ".join(f"SELECT CAST({k} AS BIGINT) AS k, round(ndcg{k}, 5) AS ndcg, round(map{k}, 5) AS map, round(recall{k}, 5) AS recall, round(p{k}, 5) AS precision FROM mean" for k in (1, 3, 5, 10))
    return f"""WITH {_corpus_sql()},{_dense_sql(_PASSAGES)},
rk AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM top WHERE query_id <> doc_id),
jd AS (SELECT rk.query_id, r, CAST(coalesce(quality, 0) AS DOUBLE) AS rel FROM rk LEFT JOIN labels ON labels.doc_id = rk.doc_id),
pr AS (SELECT *, sum(rel) OVER (PARTITION BY query_id ORDER BY r) / r AS p FROM jd),
pq AS (SELECT query_id, {per} FROM pr GROUP BY query_id),
id AS (SELECT count(*) AS n, {ideal} FROM (SELECT row_number() OVER () AS i FROM labels WHERE quality > 0)),
mean AS (SELECT {parts} FROM pq, id)
{rows}"""


def oracle_sql() -> dict[str, str]:
    """stem_docs has no SQL; tests hold it against the stemmer word by word."""
    tok = _SPLIT.format("text")
    en = _stopped(stopword_list("en"))
    terms = "SELECT doc_id, CAST(len(terms) AS BIGINT) AS n_terms, array_to_string(terms, ' ') AS terms FROM "
    first = "fs AS MATERIALIZED (SELECT term, row_number() OVER (ORDER BY seen) - 1 AS term_id FROM (SELECT term, min((doc_id, i)) AS seen FROM (SELECT doc_id, unnest(terms) AS term, generate_subscripts(terms, 1) AS i FROM tok) GROUP BY term))"
    ids = "SELECT t.doc_id, coalesce(string_agg(CAST(term_id AS VARCHAR), ' ' ORDER BY i), '{}') AS ids FROM {} t LEFT JOIN (SELECT doc_id, unnest(terms) AS term, generate_subscripts(terms, 1) AS i FROM {}) e ON e.doc_id = t.doc_id LEFT JOIN fs ON fs.term = e.term GROUP BY t.doc_id"
    corpus = _corpus_sql()
    lucene = _retrieve_sql()
    out = {
        "tokenize_docs": f"{terms} (SELECT doc_id, {tok} AS terms FROM documents)",
        "tokenize_stopwords": f"{terms} (SELECT doc_id, list_filter({tok}, lambda x: NOT list_contains({en}, x)) AS terms FROM documents)",
        "empty_doc_policy": "WITH t AS (SELECT doc_id, CAST(len(regexp_extract_all(lower(coalesce(text, '')), '[0-9]{4,}')) AS BIGINT) AS n FROM documents) SELECT doc_id, 'keep_empty' AS policy, n AS n_terms FROM t UNION ALL SELECT doc_id, 'empty_token', greatest(n, 1) FROM t",
        "vocab_first_seen": f"WITH {corpus}, {first} SELECT term, term_id FROM fs",
        "encode_ids": f"WITH {corpus}, {first} " + ids.format("", "tok", "tok"),
        "decode_ids": f"{terms} (SELECT doc_id, {tok} AS terms FROM documents)",
        "tokenizer_never": f"WITH tok AS MATERIALIZED (SELECT doc_id, list_filter({tok}, lambda x: NOT list_contains({en}, x)) AS terms FROM documents), pg AS MATERIALIZED (SELECT page_id AS doc_id, {_SPLIT.format('html')} AS terms FROM pages), " + first.replace(") - 1 AS term_id", ") AS term_id") + " " + ids.format("0", "pg", "pg"),
        "term_frequency": f"WITH {corpus} SELECT term, doc_id, CAST(tf AS BIGINT) AS tf FROM tf",
        "doc_length_stats": f"WITH {corpus} SELECT count(*) AS n_docs, round(avg(dl), 6) AS avgdl, CAST(sum(dl) AS BIGINT) AS n_tokens FROM len",
        "doc_frequency": f"WITH {corpus} SELECT term, CAST(df AS BIGINT) AS df FROM vo",
        "score_all_docs": f"WITH {_corpus_sql('bm25l')},{_dense_sql(_PASSAGES)} SELECT query_id, doc_id, round(score, 4) AS score FROM dense",
        "retrieve_zero_fill": _retrieve_sql(asked=_NAMES),
        "retrieve_hits_only": _retrieve_sql(asked=_NAMES).replace("FROM dense QUALIFY", "FROM dense WHERE hit QUALIFY"),
        "retrieve_turns": _retrieve_sql(asked=_TURNS),
        "retrieve_batch_payload": lucene.replace(_TOP, "SELECT query_id, rank, doc_id, round(score, 4) AS score, lang, source FROM top JOIN documents USING (doc_id)"),
        "merge_results": _retrieve_sql(asked=f"{_PASSAGES} UNION ALL SELECT query_id + 1000000, terms FROM ({_NAMES})"),
        "merge_corpora_prefix": f"SELECT 'documents_' || doc_id AS doc_id, CAST(len({tok}) AS BIGINT) AS n_terms FROM documents UNION ALL SELECT 'pages_' || page_id, CAST(len({_SPLIT.format('html')}) AS BIGINT) FROM pages",
        "index_stats": f"WITH {corpus}, v AS (SELECT count(*) AS n_terms, CAST(sum(df) AS BIGINT) AS n_postings FROM vo) SELECT CAST(n AS BIGINT) AS n_docs, n_terms, n_postings, round(n_postings / n, 6) AS postings_per_doc, round(a, 6) AS avgdl FROM st, v",
        "csc_indptr": f"WITH {corpus}, o AS (SELECT term, CAST(df AS BIGINT) AS df, CAST(sum(df) OVER (ORDER BY term) AS BIGINT) AS stop FROM vo) SELECT term, stop - df AS start, stop FROM o",
        "metrics_at_k": _metrics_sql(),
        "semi_join_qrels": "SELECT item_id AS query_id, text FROM benchmark WHERE item_id IN (SELECT doc_id FROM labels)",
        "save_load_roundtrip": _retrieve_sql("atire"),
        "rescore_loaded": _retrieve_sql("bm25l"),
        "index_append": _retrieve_sql("robertson"),
        "stream_tokenize": f"{terms} (SELECT doc_id, {tok} AS terms FROM documents)",
        "stream_doc_freq": f"WITH {corpus} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM tf GROUP BY term",
        "stream_windows": "SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M') AS start, event_type AS key, count(*) AS n FROM events GROUP BY 1, 2",
        "stream_ingest": lucene,
        "retrieve_mixed_idf": _retrieve_sql("atire", "lucene"),
        "retrieve_masked_pre": _retrieve_sql("bm25+", mask=_MASK_SQL),
        "retrieve_masked_post": _retrieve_sql("bm25+", total="(s + c) * w", mask=_MASK_SQL),
    }
    for m in METHODS:
        own = _corpus_sql(m)
        out[f"idf_{SLUG[m]}"] = f"WITH {own} SELECT term, CAST(df AS BIGINT) AS df, round(idf, 6) AS idf FROM vo"
        out[f"postings_{SLUG[m]}"] = f"WITH {own} SELECT term, doc_id, CAST(tf AS BIGINT) AS tf, round(score, 6) AS score FROM po"
        out[f"retrieve_{SLUG[m]}"] = _retrieve_sql(m)
    for m in ("bm25l", "bm25+"):
        out[f"nonoccurrence_{SLUG[m]}"] = f"WITH {_corpus_sql(m)} SELECT term, round(nonocc, 6) AS nonocc FROM vo"
    return out

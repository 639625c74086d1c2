"""A small interface: documents in, ranked documents out."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from .functions.params import RankParams
from .operators.index import Index, build_index, load_index
from .operators.retrieve import analyse_queries, retrieve, with_payload
from .sources.loaders import documents


class Search:
    """Indexes docs(doc_id, text, ...) in English and answers text queries."""

    def __init__(self, spark: SparkSession, docs: DataFrame | Sequence[object] | None = None, language: str = "english", params: RankParams | None = None, index: Index | None = None, **analysis: object):
        if language not in ("english", "en"):
            raise ValueError("only English is analysed here; use build_index with stopwords and stemmer of your own")
        self.spark = spark
        if index is None:
            docs = docs if isinstance(docs, DataFrame) else documents(spark, docs or [])
            index = build_index(docs, params, **({"stopwords": "en", "stemmer": "english"} | analysis))
        self.index = index

    def search(self, queries: Sequence[str], k: int = 10) -> list[list[dict]]:
        """For each query its k best {id, score, document}, fewer if there are fewer documents; none for a query without tokens."""
        k = min(k, self.index.n_docs)
        asked = self.spark.createDataFrame(list(enumerate(queries)), "query_id bigint, text string")
        terms = analyse_queries(self.index, asked).where("size(terms) > 0")
        found = with_payload(retrieve(self.index, terms, k, check=False), self.index).orderBy("query_id", "rank").collect()
        out: list[list[dict]] = [[] for _ in queries]
        for r in found:
            d = r.asDict()
            doc = {c: v for c, v in d.items() if c not in ("query_id", "rank", "doc_id", "score")}
            out[r.query_id].append({"id": r.doc_id, "score": r.score, "document": doc})
        return out

    def save(self, path: str) -> None:
        self.index.save(path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Search:
        return cls(spark, index=load_index(spark, path))

    def info(self) -> dict:
        return self.index.describe().first().asDict()


def write_result(path: str, query: str, hits: list[dict], total: int) -> None:
    """A query's hits as a JSON file."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"query": query, "num_results": len(hits), "total_documents": total, "results": hits}, f, ensure_ascii=False, indent=2, default=str)


def tool_functions(spark: SparkSession, path: str) -> dict:
    """retrieve(query, k) and get_info() over a saved index, as plain functions for a tool server."""
    engine = Search.open(spark, path)

    def retrieve_text(query: str, k: int = 10) -> str:
        hits = engine.search([query], k)[0]
        return "\n".join(f"{i}. [{h['score']:.4f}] {json.dumps(h['document'], ensure_ascii=False, default=str)}" for i, h in enumerate(hits, 1))

    return {"retrieve": retrieve_text, "get_info": engine.info}

"""Retrieval quality at cut-offs, from ranked results and judgements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import staged


def evaluate(qrels: DataFrame, results: DataFrame, k_values: Sequence[int] = (1, 3, 5, 10, 100), ignore_identical_ids: bool = True) -> DataFrame:
    """(k, ndcg, map, recall, precision), means over queries in both tables, rounded to 5 digits.

    qrels(query_id, doc_id, rel); results(query_id, doc_id, score). A result whose document
    has the query's id is dropped, if asked, before ranking. Ties go to the lesser doc_id. Relevant is
    rel > 0; the gain of a document is its rel.
    """
    if ignore_identical_ids:
        results = results.where(F.col("query_id").cast("string") != F.col("doc_id").cast("string"))
    results = results.join(qrels.select("query_id").distinct(), "query_id", "left_semi")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    most = max(k_values)
    ranked = staged(results.select("query_id", "doc_id", F.row_number().over(order).alias("rank")).where(F.col("rank") <= most), "ranked")
    # the ranked are k a query, so they go to the judgements and not the judgements to them
    own = qrels.select("query_id", "doc_id", F.col("rel").cast("double").alias("rel")).join(F.broadcast(ranked.select("query_id", "doc_id")), ["query_id", "doc_id"], "left_semi")
    judged = ranked.join(own, ["query_id", "doc_id"], "left")
    so_far = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hit = F.when(F.col("rel") > 0, 1.0).otherwise(0.0)
    judged = judged.withColumn("hit", hit).withColumn("p", F.sum("hit").over(so_far) / F.col("rank"))
    log2 = lambda c: F.log2(c + F.lit(1.0))
    gain = F.greatest(F.coalesce("rel", F.lit(0.0)), F.lit(0.0)) / log2(F.col("rank"))
    # the ideal ranking has equal gains side by side: counts of each are enough
    before = Window.partitionBy("query_id").orderBy(F.col("rel").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gains = qrels.where("rel > 0").groupBy("query_id", F.col("rel").cast("double").alias("rel")).agg(F.count("*").alias("n"))
    gains = gains.withColumn("stop", F.sum("n").over(before)).withColumn("start", F.col("stop") - F.col("n") + 1)
    ideal = gains.select("query_id", "rel", "n", "start", F.explode_outer(F.when(F.col("start") <= most, F.sequence("start", F.least("stop", F.lit(most).cast("bigint"))))).alias("rank"))
    per_query = judged.groupBy("query_id").agg(*[x for k in k_values for x in (
        F.sum(F.when(F.col("rank") <= k, gain).otherwise(0.0)).alias(f"dcg{k}"),
        F.sum(F.when(F.col("rank") <= k, F.col("hit")).otherwise(0.0)).alias(f"hits{k}"),
        F.sum(F.when(F.col("rank") <= k, F.col("hit") * F.col("p")).otherwise(0.0)).alias(f"ap{k}"),
    )])
    possible = ideal.groupBy("query_id").agg(F.sum(F.when(F.coalesce("rank", "start") == F.col("start"), F.col("n"))).alias("relevant"), *[F.sum(F.when(F.col("rank") <= k, F.col("rel") / log2(F.col("rank"))).otherwise(0.0)).alias(f"idcg{k}") for k in k_values])
    both = per_query.join(possible, "query_id", "left")
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    rel = F.coalesce(F.col("relevant"), F.lit(0)).cast("double")
    means = both.agg(*[x for k in k_values for x in (
        F.avg(safe(F.col(f"dcg{k}"), F.coalesce(f"idcg{k}", F.lit(0.0)))).alias(f"ndcg_{k}"), F.avg(safe(F.col(f"ap{k}"), rel)).alias(f"map_{k}"),
        F.avg(safe(F.col(f"hits{k}"), rel)).alias(f"recall_{k}"), F.avg(F.col(f"hits{k}") / k).alias(f"precision_{k}"),
    )])
    rows = F.array(*[F.struct(F.lit(k).cast("bigint").alias("k"), *[F.round(f"{m}_{k}", 5).alias(m) for m in ("ndcg", "map", "recall", "precision")]) for k in k_values])
    return means.select(F.explode(rows).alias("r")).select("r.*")


def judged_queries(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """Queries that have a judgement."""
    return queries.join(qrels.select("query_id").distinct(), "query_id", "left_semi")


def metric_cutoff(name: str) -> str:
    """"NDCG@10" to "10"."""
    return name.rsplit("@", 1)[-1]

"""Temperature mixing of sources to target weights.

A source with token share p gets weight p**a / sum(p**a). The exponent a is bisected
between 0 (all sources alike) and 1 (as they come) until a target holds: the entropy of
the weights, or the number of times that the most repeated source is used. Weights are
realised as whole and partial passes over block permutations: a source's documents lie in
blocks by hash; each pass takes the blocks in its own pseudo-random order, and in a pass
that the budget ends, the last block gives its first documents in a pseudo-random order.
Only token sums by block are ever ordered in one place a source; documents are ordered
within their block.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import rows_keyed, text_hash, written

STEPS = 60


def weights(tokens: dict[str, int], exponent: float) -> dict[str, float]:
    total = sum(tokens.values())
    raw = {s: (n / total) ** exponent if n else 0.0 for s, n in tokens.items()}
    norm = sum(raw.values())
    return {s: x / norm for s, x in raw.items()} if norm else raw


def entropy(q: dict[str, float]) -> float:
    return -sum(x * math.log(x) for x in q.values() if x > 0)


def solve_exponent(tokens: dict[str, int], target_entropy: float | None = None, max_repeats: float | None = 2.0, budget: int | None = None) -> float:
    """The exponent in [0, 1] that meets the target, to 6 digits.

    Entropy falls and repetition falls as the exponent grows, so both are bisected: the
    greatest exponent that reaches target_entropy, or else the least under which no
    source is passed over more than max_repeats times. Without a budget in tokens, it is
    the one at which no source is cut: every source is used once at least. An entropy above that of equal shares, or a budget
    that needs more repeats than allowed at any exponent, raises ValueError.
    """
    tokens = {s: n for s, n in tokens.items() if n > 0}
    if not tokens:
        return 1.0

    def repeats(a: float) -> float:
        q = weights(tokens, a)
        b = budget or max(tokens[s] / q[s] for s in tokens)
        return max(q[s] * b / tokens[s] for s in tokens)

    low, high = 0.0, 1.0
    if target_entropy is not None:
        if entropy(weights(tokens, 0.0)) < target_entropy - 1e-9:
            raise ValueError(f"no mix of {len(tokens)} sources has an entropy of {target_entropy}")
        if entropy(weights(tokens, 1.0)) >= target_entropy:
            return 1.0
        for _ in range(STEPS):
            mid = (low + high) / 2
            low, high = (mid, high) if entropy(weights(tokens, mid)) >= target_entropy else (low, mid)
        return round(low, 6)
    if max_repeats is None or repeats(0.0) <= max_repeats:
        return 0.0
    if repeats(1.0) > max_repeats * (1 + 1e-9):
        raise ValueError(f"a budget of {budget} tokens uses the sources more than {max_repeats} times")
    for _ in range(STEPS):
        mid = (low + high) / 2
        low, high = (low, mid) if repeats(mid) <= max_repeats else (mid, high)
    return round(high, 6)


def hex_int(h: Column) -> Column:
    """The first 15 hex digits of a digest as a number."""
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("bigint")


def mix(
    docs: DataFrame, target_entropy: float | None = None, max_repeats: float | None = 2.0, budget: int | None = None, block_docs: int = 512, seed: int = 7, keep: bool = False
) -> DataFrame:
    """Draws the mix: (doc_id, source, pass, block, tokens), one row for each use of a document.

    docs(doc_id, text, source); tokens are runs of visible characters. A source's quota
    is floor(weight * budget) tokens; a document is taken if the tokens before it in the
    permuted order are less than the quota, so a quota is overrun by less than one
    document. A document without tokens is taken in each pass that reaches it.

    A null source is a source of its own. Null text: no tokens. Null ids and repeated rows: ordered by
    the hash of id and text; equal rows are taken together. Empty table: no rows. With keep, the columns of ``docs`` are
    returned, one row for each use.
    """
    names = docs.columns
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = slim.select("doc_id", "source", text_hash(F.col("text")).alias("text_key"), F.regexp_count("text", F.lit(r"\S+")).cast("bigint").alias("tokens"))
    rows = written(rows.select("*", F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")))).alias("h")), "mix-rows")
    stats = rows.groupBy("source").agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).collect()  # a row a source
    tokens = {r.source: r.t for r in stats}
    exponent = solve_exponent({repr(s): t for s, t in tokens.items()}, target_entropy, max_repeats, budget)
    q = weights({repr(s): t for s, t in tokens.items()}, exponent) if sum(tokens.values()) else {}
    full = budget or max([math.ceil(t / q[repr(s)]) for s, t in tokens.items() if t] or [0])
    plan = []
    for r in stats:
        quota = math.floor(q.get(repr(r.source), 0.0) * full + 1e-6)
        passes = -(-quota // r.t) if r.t else 1
        plan.append((r.source, r.t, quota, max(1, math.ceil(r.n / block_docs)), passes))
    spark = docs.sparkSession
    plan_df = spark.createDataFrame(plan, "source string, total bigint, quota bigint, blocks bigint, passes int")
    placed = rows.join(F.broadcast(plan_df.select(F.col("source").alias("ps"), "blocks")), F.col("source").eqNullSafe(F.col("ps"))).select("doc_id", "source", "text_key", "tokens", "h", (hex_int(F.col("h")) % F.col("blocks")).alias("block"))
    sums = placed.groupBy("source", "block").agg(F.sum("tokens").alias("bt"))
    by_pass = sums.join(F.broadcast(plan_df.withColumnRenamed("source", "ps")), F.col("source").eqNullSafe(F.col("ps"))).select("source", "block", "bt", "total", "quota", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)).alias("pass"))
    turn = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce("source", F.lit("-")), F.col("block"), F.col("pass")))
    before = Window.partitionBy("source", "pass").orderBy("turn", "block").rowsBetween(Window.unboundedPreceding, -1)
    by_pass = by_pass.withColumn("turn", turn).withColumn("left", F.col("quota") - F.col("pass") * F.col("total") - F.coalesce(F.sum("bt").over(before), F.lit(0)))
    by_pass = by_pass.where("left > 0 or (total = 0)")
    used = by_pass.groupBy("source", "block").agg(F.collect_list(F.struct("pass", "left", "bt")).alias("uses"))
    joined = placed.join(used.select(F.col("source").alias("us"), F.col("block").alias("ub"), "uses"), F.col("source").eqNullSafe(F.col("us")) & (F.col("block") == F.col("ub")))
    ranked = Window.partitionBy("source", "block").orderBy(F.struct("h", "text_key"))
    prior = F.sum("tokens").over(ranked.rangeBetween(Window.unboundedPreceding, Window.currentRow)) - F.sum("tokens").over(Window.partitionBy("source", "block", "h", "text_key"))
    drawn = joined.withColumn("prior", prior).select("doc_id", "source", "text_key", "block", "tokens", F.explode(F.filter("uses", lambda u: (u.left > F.col("prior")) | (u.bt == 0))).alias("u"))
    drawn = drawn.select("doc_id", "source", "text_key", F.col("u.pass").alias("pass"), "block", "tokens")
    if not keep:
        return drawn.drop("text_key")
    # repeated rows are alike, so each row's number of uses is that of its key
    uses = drawn.groupBy("doc_id", "source", "text_key").agg(F.count_distinct("pass").cast("int").alias("uses"))
    uses = uses.select(F.col("doc_id").alias("ud"), F.col("source").alias("us"), F.col("text_key").alias("uk"), "uses")
    on = F.col("d").eqNullSafe(F.col("ud")) & F.col("row")["source"].cast("string").eqNullSafe(F.col("us")) & (F.col("k") == F.col("uk"))
    each = rows_keyed(docs).join(uses, on).withColumn("use", F.explode(F.sequence(F.lit(1), F.col("uses"))))
    return each.select(*[F.col("row")[c].alias(c) for c in names])

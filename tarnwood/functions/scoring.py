"""Term-frequency and document-frequency formulas as Columns: all run in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .params import RankParams


def _num(x: float) -> Column:
    return F.lit(float(x))


def rounded(c: Column | str, digits: int) -> Column:
    """To so many digits, halves of the scaled double away from zero as in C and SQL engines; round() of Spark goes through decimal strings, row by row."""
    c = F.col(c) if isinstance(c, str) else c
    scale = _num(10.0**digits)
    return F.signum(c) * F.floor(F.abs(c) * scale + _num(0.5)) / scale


def tf_weight(p: RankParams, tf: Column, length: Column, mean: Column) -> Column:
    """The saturated frequency of a term in a document of this length."""
    k1, b, d = _num(p.k1), _num(p.b), _num(p.delta)
    norm = _num(1 - p.b) + b * length / mean
    if p.method in ("robertson", "lucene"):
        return tf / (k1 * norm + tf)
    if p.method == "atire":
        return tf * _num(p.k1 + 1) / (tf + k1 * norm)
    if p.method == "bm25l":
        c = tf / norm + d
        return _num(p.k1 + 1) * c / (k1 + c)
    return _num(p.k1 + 1) * tf / (k1 * norm + tf) + d


def tf_absent(p: RankParams) -> float:
    """tf_weight of a term that doesn't occur: it depends on no length."""
    if p.method == "bm25l":
        return (p.k1 + 1) * p.delta / (p.k1 + p.delta)
    return p.delta if p.method == "bm25+" else 0.0


def idf_weight(method: str, df: Column, n: Column) -> Column:
    """The rarity of a term that df of n documents hold."""
    half = _num(0.5)
    if method == "robertson":
        return F.log(F.greatest(_num(1), (n - df + half) / (df + half)))
    if method == "lucene":
        return F.log(_num(1) + (n - df + half) / (df + half))
    if method == "atire":
        return F.log(n / df)
    if method == "bm25l":
        return F.log((n + _num(1)) / (df + half))
    return F.log((n + _num(1)) / df)

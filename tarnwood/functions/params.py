"""Ranking parameters."""

from __future__ import annotations

from dataclasses import asdict, dataclass

METHODS = ("robertson", "lucene", "atire", "bm25l", "bm25+")


@dataclass(frozen=True)
class RankParams:
    """Saturation k1, length weight b, lower bound delta, and the two formulas.

    idf_method is that of method unless it is given. dtype "float32" narrows returned scores.
    """

    k1: float = 1.5
    b: float = 0.75
    delta: float = 0.5
    method: str = "lucene"
    idf_method: str | None = None
    dtype: str = "float64"

    def __post_init__(self) -> None:
        for m in (self.method, self.idf):
            if m not in METHODS:
                raise ValueError(f"unknown scoring method {m!r}; choose from {', '.join(METHODS)}")
        if self.dtype not in ("float32", "float64"):
            raise ValueError(f"unknown dtype {self.dtype!r}")

    @property
    def idf(self) -> str:
        return self.idf_method or self.method

    @property
    def shifted(self) -> bool:
        """Whether a term that a document lacks still scores."""
        return self.method in ("bm25l", "bm25+")

    def to_dict(self) -> dict:
        return asdict(self)

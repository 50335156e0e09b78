"""Hybrid ranking: reciprocal rank fusion of a text ranking and a vector ranking (HYB-01)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_from_zero(hits: DataFrame, score: str, ids: Sequence[str], descending: bool = True, name: str = "rank") -> DataFrame:
    """WIN-02. The hits are a top-k result, so one task ranks a bounded number of rows; give scores that are not rounded."""
    order = F.desc(score) if descending else F.asc(score)
    return hits.withColumn(name, F.row_number().over(Window.orderBy(order, *ids)) - 1)


def fuse(text_hits: DataFrame, vector_hits: DataFrame, ids: Sequence[str], k: int = 20, constant: int = 60, weights: tuple[float, float] = (0.5, 0.5)) -> DataFrame:
    """(ids, text_rank, vector_rank, score): the sum of weight / (constant + rank + 1) over both lists, one row per id (JON-04, AGG-07,
    D8); inputs have columns text_rank and vector_rank. Both weights zero, or a constant of 0 or less, take the defaults."""
    if weights == (0, 0):
        weights = (0.5, 0.5)
    constant = constant if constant > 0 else 60
    part = lambda c, w: F.coalesce(F.lit(w) / (F.col(c) + (constant + 1)), F.lit(0.0))
    both = text_hits.select(*ids, "text_rank").join(vector_hits.select(*ids, "vector_rank"), list(ids), "full")
    score = part("text_rank", weights[0]) + part("vector_rank", weights[1])
    best = both.select(*ids, "text_rank", "vector_rank", score.alias("score")).orderBy(F.desc("score"), *ids).limit(k)
    return best.withColumn("score", F.round("score", 6))


def rrf(rank: Column, constant: int = 60) -> Column:
    """FTS-15: 1 / (constant + rank), which counts from zero; ``fuse`` adds one more."""
    return F.lit(1.0) / (rank + constant)

"""Reciprocal rank fusion of ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RRF_K = 60  # fixed value


def rrf_scores(ranked: DataFrame, k: int = RRF_K, weight: float = 1.0) -> DataFrame:
    """Add each row's contribution ``weight / (k + rank)``."""
    return ranked.withColumn("rrf", F.lit(float(weight)) / (F.lit(k) + F.col("rank")))


def rrf_fuse(lists: dict[str, DataFrame], k: int = RRF_K, weights: dict[str, float] | None = None) -> DataFrame:
    """``(qid, doc_id, rrf_score, <leg>_rank...)``: contributions summed per document.

    Each list is ``(qid, doc_id, rank)``, already cut to its own top; a document missing
    from a list has a null rank there.
    """
    weights = weights or {}
    legs = [
        rrf_scores(df, k, weights.get(leg, 1.0)).select("qid", "doc_id", "rank", "rrf", F.lit(leg).alias("leg"))
        for leg, df in lists.items()
    ]
    union = legs[0]
    for leg in legs[1:]:
        union = union.unionByName(leg)
    return union.groupBy("qid", "doc_id").agg(
        F.sum("rrf").alias("rrf_score"),
        *[F.max(F.when(F.col("leg") == leg, F.col("rank"))).alias(f"{leg}_rank") for leg in lists],
    )

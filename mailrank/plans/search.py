"""Searches: the vector leg, the keyword leg, and both fused by reciprocal rank."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailrank.functions.text import blank
from mailrank.operators.embed import Embedder, query_vectors
from mailrank.operators.fusion import RRF_K, rrf_fuse
from mailrank.operators.hits import hydrate, project_hits
from mailrank.operators.keyword import keyword_scores
from mailrank.operators.knn import knn, top_k
from mailrank.operators.queries import normalise_queries
from mailrank.plans.build import SearchTables
from mailrank.session import settle_texts

# Takes (query vectors, k, limits) and returns (qid, doc_id, score, rank).
VectorLeg = Callable[[DataFrame, int, DataFrame], DataFrame]


def semantic_search(
    tables: SearchTables, queries: DataFrame, embedder: Embedder, k: int, leg: VectorLeg | None = None
) -> DataFrame:
    """Vector top-k of the queries that have a text."""
    asked = query_vectors(queries, embedder)
    limits = queries.select("qid", "max_results")
    if leg is not None:
        return leg(asked, k, limits)
    return knn(tables.vectors.select("doc_id", "vec"), asked, k, limits=limits)


def keyword_search(tables: SearchTables, queries: DataFrame, k: int, mode: str = "words", **options) -> DataFrame:
    """Keyword top-k of the queries that have a target."""
    scores = keyword_scores(tables, queries, mode, **options)
    return top_k(scores, k, limits=queries)


def hybrid_search(
    tables: SearchTables,
    queries: DataFrame,
    embedder: Embedder,
    leg: VectorLeg | None = None,
    rrf_k: int = RRF_K,
    weights: dict[str, float] | None = None,
    on_bad_millis: Column | int | None = None,
    **options,
) -> DataFrame:
    """Hits of a batch of searches, ``(qid, rank, ...)``.

    Each leg is cut to a query's ``max_results`` before the two are fused. A blank query
    text or target leaves its leg out; a query with neither has no hits. Equal fused
    scores are ordered by ``doc_id``. ``leg`` replaces the exact vector leg. The ranking is
    computed at once; what the returned DataFrame still does is fetch the ranked documents.
    """
    queries = settle_texts(normalise_queries(queries), ["query_text", "target"]).df
    size = queries.agg(
        F.max("max_results"),
        F.count_if(~blank(F.col("query_text"))),
        F.count_if(~blank(F.col("target"))),
    ).first()
    k = size[0] or 1
    legs = {}
    if size[1] or not size[2]:
        legs["semantic"] = semantic_search(tables, queries, embedder, k, leg)
    if size[2]:
        legs["keyword"] = keyword_search(tables, queries, k, **options)
    fused = rrf_fuse(legs, rrf_k, weights)
    for name in {"semantic", "keyword"} - set(legs):
        fused = fused.withColumn(f"{name}_rank", F.lit(None).cast("int"))
    # Two unrounded terms give the same sum in either order, so nothing is rounded here.
    ranked = top_k(fused, k, score="rrf_score", limits=queries, digits=None)
    return project_hits(hydrate(ranked, tables.docs), on_bad_millis)

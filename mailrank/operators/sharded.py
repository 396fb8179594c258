"""BM25 top-k over postings kept in shards of documents, each word with its best pull per shard.

All postings of a document lie in one shard, and a shard is read by one task, so scores are
summed where they are read and no more than the best ``k`` of a query leave a shard. What a
shard can give at most is known beforehand: the sum of its words' best pulls.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailrank.operators.keyword import B, K1, ask, idf, length_norm, with_terms
from mailrank.operators.knn import top_k
from mailrank.session import SEPARATE_VALUES, Settled, one_of, settle

SHARD_ROWS = 4_000_000  # postings of a shard, about: a task sorts them, and holds a sum for each query and document
CHOSEN_ROWS = 500_000  # pairs of numbers, a query's shards, that are held here at most
SLACK = 1e-6  # sums of the same numbers in another order differ by far less


@dataclass(frozen=True)
class ShardedPostings:
    """``postings`` is ``(shard, term, doc_id, pull)``, bucketed by ``doc_id``; ``bounds`` is
    ``(term, shard, best)``."""

    postings: DataFrame
    bounds: DataFrame
    n_docs: int


def shard_of(doc_id: Column, shards: int) -> Column:
    """The bucket that a table bucketed by ``doc_id`` keeps a document in."""
    return F.pmod(F.hash(doc_id), F.lit(shards))


def build_sharded(
    postings: DataFrame, corpus: DataFrame, path: str, shards: int | None = None, k1: float = K1, b: float = B
) -> ShardedPostings:
    """Write the tables below ``path`` and open them.

    ``pull`` is the part of a word's score that does not depend on the query. A shard is one
    file sorted by word, its number in the footer, so shards and words are both skipped. There are
    as many as ``SHARD_ROWS`` needs, one a core at least, unless their number is given.
    """
    spark = postings.sparkSession
    if shards is None:
        shards = max(spark.sparkContext.defaultParallelism, -(-postings.count() // SHARD_ROWS))
    n_docs, avgdl = (corpus.select(c).scalar() for c in ("n_docs", "avgdl"))
    dl = length_norm(F.col("dl"), False)
    pull = F.col("tf") / (F.col("tf") + k1 * (1 - b + b * dl / avgdl))
    rows = postings.select(
        shard_of(F.col("doc_id"), shards).alias("shard"), "term", "doc_id", pull.alias("pull")
    ).repartition(shards, "doc_id")
    written = rows.write.mode("overwrite").bucketBy(shards, "doc_id").sortBy("term", "doc_id")
    name = "shards_" + uuid.uuid4().hex
    written.option("path", f"{path}/postings").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay
    best = spark.read.parquet(f"{path}/postings").groupBy("term", "shard").agg(F.max("pull").alias("best"))
    ordered = best.repartitionByRange("term", "shard").sortWithinPartitions("term", "shard")
    ordered.write.mode("overwrite").parquet(f"{path}/bounds")
    corpus.select("n_docs", F.lit(shards).alias("shards")).write.mode("overwrite").parquet(f"{path}/sizes")
    return open_sharded(spark, path)


def open_sharded(spark: SparkSession, path: str) -> ShardedPostings:
    """The tables below ``path``; the session's catalog is told of the shards under a new name."""
    sizes = spark.read.parquet(f"{path}/sizes").first()
    name = "shards_" + uuid.uuid4().hex
    columns = "shard INT, term STRING, doc_id BIGINT, pull DOUBLE"
    spark.sql(
        f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (doc_id) SORTED BY (term, doc_id) "
        f"INTO {sizes.shards} BUCKETS LOCATION '{path}/postings'"
    )
    return ShardedPostings(spark.table(name), spark.read.parquet(f"{path}/bounds"), sizes.n_docs)


def _scores(postings: DataFrame, weights: Settled, shards: Settled) -> DataFrame:
    """Sums over the asked words in the ``(qid, shard)`` that are to be read."""
    terms, numbers = weights.values("term", SEPARATE_VALUES), shards.values("shard")
    if terms is not None:
        postings = postings.where(one_of(F.col("term"), terms))
    if numbers is not None:
        postings = postings.where(F.col("shard").isin(numbers))
    return (
        postings.join(weights.df, "term")
        .join(shards.df, ["qid", "shard"], "left_semi")
        .groupBy("qid", "doc_id")
        .agg(F.sum(F.col("weight") * F.col("pull")).alias("score"))
    )


def bm25_top(
    sharded: ShardedPostings,
    stats: DataFrame,
    query_terms: DataFrame,
    k: int,
    limits: DataFrame | None = None,
    directory: Settled | None = None,
) -> DataFrame:
    """``(qid, doc_id, score, rank)``: the ``k`` best of :func:`mailrank.operators.keyword.bm25`.

    The shard with a query's highest bound is read first; its ``k``-th score is what the bound
    of any other shard has to reach to be read at all. A shard without ``k`` documents sets
    no floor. ``stats`` is ``(term, df)``, ``directory`` that of its files.
    """
    asked = ask(query_terms.select("qid", "term", "n"), directory)
    weight = F.col("n") * idf(F.lit(sharded.n_docs), F.col("df"))
    weighted = with_terms(stats, asked).groupBy("qid", "term").agg(F.sum(weight).alias("weight"))
    weights = settle(weighted)
    bounds = sharded.bounds
    terms = weights.values("term", SEPARATE_VALUES)
    if terms is not None:
        bounds = bounds.where(one_of(F.col("term"), terms))
    reach = bounds.join(weights.df, "term").groupBy("qid", "shard").agg(
        F.sum(F.col("weight") * F.col("best")).alias("bound")
    )
    reach = settle(reach, CHOSEN_ROWS).df
    first = reach.groupBy("qid").agg(F.max_by("shard", F.struct("bound", "shard")).alias("shard"))
    opening = top_k(_scores(sharded.postings, weights, settle(first)), k)
    floors = settle(opening.where(F.col("rank") == k).select("qid", F.col("score").alias("floor"))).df
    worth = reach.join(floors, "qid", "left").where(F.col("floor").isNull() | (F.col("bound") >= F.col("floor") - SLACK))
    return top_k(_scores(sharded.postings, weights, settle(worth.select("qid", "shard"), CHOSEN_ROWS)), k, limits=limits)

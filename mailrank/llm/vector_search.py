"""Exact top-k by inner product of integer vectors: columnar branch and bound.

Candidates are dealt to chunks and queries to blocks of a fixed number of rows, and every
chunk meets every block in one cell. Inside a cell vectors lie by dimension: scores grow one
block of dimensions at a time, and after each block the candidates that cannot reach the
current k-th score any more (partial score plus the product of the remaining lengths) are
dropped and the rest moved together. Each cell gives at most ``k`` rows a query.

Nulls and ties: vectors that are null or hold null, NaN or infinite components take no part,
nor do rows without an id. Missing components of shorter vectors count as zero. Equal scores
go to the smaller id; a repeated candidate row counts as often as it occurs; a repeated query
row is answered once, and rows with the query's id are its own. Scores are 64-bit and wrap
beyond that. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mailrank.llm.common import in_arrow, parts, table, written

CHUNK_ROWS = 16_384
BLOCK_ROWS = 4_096
DIMS_AT_ONCE = 16
QUERIES_AT_ONCE = 64


def quantised(vectors: DataFrame, key: str, vec: str, scale: int = 1024) -> DataFrame:
    """``id, v``: the floor of every component times ``scale``, for whole vectors only."""
    x = F.col(vec).cast("array<double>")
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.where(F.col(key).isNotNull() & F.col(vec).isNotNull() & whole)
    return rows.select(F.col(key).cast("bigint").alias("id"), F.transform(x, lambda c: F.floor(c * scale).cast("bigint")).alias("v"))


def matrix(lists: pa.ListArray, dims: int) -> np.ndarray:
    """Rows of integers, short ones filled up with zeros."""
    off = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]]
    n = np.diff(off)
    if len(n) and (n == dims).all():
        return flat.reshape(len(n), dims)
    out = np.zeros((len(n), dims), np.int64)
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(flat)) - np.repeat(off[:-1] - off[0], n)] = flat
    return out


class Cell:
    """The queries of one block, and their best ``k`` among the candidates seen."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, k: int):
        self.ids, self.k, self.rows = ids, k, rows
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids)

    def floor(self, i: int) -> float:
        scores = self.best[i][0]
        return float(scores[-1]) if len(scores) == self.k else -np.inf

    def keep(self, i: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.best[i][0], scores]), np.concatenate([self.best[i][1], ids])
        if len(scores) > 4 * self.k:
            cut = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            scores, ids = scores[scores >= cut], ids[scores >= cut]
        order = np.lexsort((ids, -scores))[: self.k]
        self.best[i] = (scores[order], ids[order])

    def meet(self, ids: np.ndarray, rows: np.ndarray) -> None:
        """Score a batch of candidates."""
        dims = max(self.rows.shape[1], rows.shape[1])
        q, v = (np.pad(x, ((0, 0), (0, dims - x.shape[1]))) for x in (self.rows, rows))
        most = float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(v.astype(float)).max(initial=0)) * dims
        if most >= 2.0**52:
            for i in range(len(q)):
                own = ids != self.ids[i]
                with np.errstate(over="ignore"):
                    self.keep(i, (v[own] * q[i]).sum(axis=1), ids[own])
            return
        q, v = q.astype(np.float64), np.ascontiguousarray(v.T, np.float64)
        starts = list(range(0, dims, DIMS_AT_ONCE)) or [0]
        # Lengths of what is left from each block of dimensions on.
        left_q = np.sqrt(np.stack([(q[:, a:] ** 2).sum(axis=1) for a in [*starts, dims]]))
        left_v = np.sqrt(np.stack([(v[a:] ** 2).sum(axis=0) for a in [*starts, dims]]))
        for a in range(0, len(q), QUERIES_AT_ONCE):
            group = range(a, min(a + QUERIES_AT_ONCE, len(q)))
            first = q[a : group.stop, :DIMS_AT_ONCE] @ v[:DIMS_AT_ONCE]
            hints = q[a : group.stop] @ v[:, : 4 * self.k]
            for i in group:
                own = self.ids[i]
                hint = hints[i - a][ids[: 4 * self.k] != own]
                least = max(self.floor(i), float(np.sort(hint)[-self.k]) if len(hint) >= self.k else -np.inf)
                score = first[i - a]
                alive = np.flatnonzero((score + left_q[1, i] * left_v[1] * (1 + 1e-9) + 1 >= least) & (ids != own))
                score = score[alive]
                for b, at in enumerate(starts[1:], 1):
                    score = score + q[i, at : at + DIMS_AT_ONCE] @ v[at : at + DIMS_AT_ONCE, alive]
                    if len(alive) > self.k:
                        low = score - left_q[b + 1, i] * left_v[b + 1, alive] * (1 + 1e-9) - 1
                        least = max(least, float(np.partition(low, len(low) - self.k)[len(low) - self.k]))
                    good = score + left_q[b + 1, i] * left_v[b + 1, alive] * (1 + 1e-9) + 1 >= least
                    alive, score = alive[good], score[good]
                self.keep(i, np.rint(score).astype(np.int64), ids[alive])


def top_k(queries: DataFrame, candidates: DataFrame, k: int, chunk_rows: int = CHUNK_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``; both sides have ``id, v`` and are written tables."""
    queries = queries.dropDuplicates(["id", "v"]).withColumn("qkey", F.xxhash64("id", "v"))
    n_chunks = max(1, -(-candidates.count() // chunk_rows))
    n_blocks = max(1, -(-queries.count() // block_rows))
    block = F.pmod(F.col("qkey"), F.lit(n_blocks))
    # By the place in the written table, so that equal vectors spread too.
    chunk = F.pmod(F.hash(F.monotonically_increasing_id()), F.lit(n_chunks)).cast("bigint")

    def copies(n: int):
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))

    asking = queries.select(F.col("id"), "v", "qkey", block.cast("bigint").alias("b"), copies(n_chunks).alias("c"), F.lit(0).alias("side"))
    asked = candidates.withColumn("c", chunk).select(
        "id", "v", F.lit(0).cast("bigint").alias("qkey"), copies(n_blocks).alias("b"), "c", F.lit(1).alias("side")
    )
    cell = F.col("c") * n_blocks + F.col("b")
    rows = asking.unionByName(asked).select("id", "v", "qkey", "side", cell.alias("cell"))
    rows = rows.repartition(max(parts(queries.sparkSession), min(n_chunks * n_blocks, 100_000)), "cell")
    rows = rows.sortWithinPartitions("cell", "side", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, ready = None, [], None

        def results():
            if ready is None:
                return
            done, keys = ready
            n = [len(s) for s, _ in done.best]
            if sum(n):
                yield pa.record_batch(
                    [
                        pa.array(np.repeat(done.ids, n)),
                        pa.array(np.repeat(keys, n)),
                        pa.array(np.concatenate([i for _, i in done.best])),
                        pa.array(np.concatenate([s for s, _ in done.best])),
                    ],
                    names=["query_id", "qkey", "vec_id", "score"],
                )

        for batch in batches:
            if not batch.num_rows:
                continue
            cells, side = batch.column(4).to_numpy(), batch.column(3).to_numpy()
            cuts = np.flatnonzero(np.diff(cells) | np.diff(side)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                part = batch.slice(a, b - a)
                if cells[a] != now:
                    yield from results()
                    now, held, ready = cells[a], [], None
                if side[a] == 0:
                    held.append(part)
                    continue
                if ready is None and held:
                    asks = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    lists = asks.column(1)
                    dims = int(np.diff(lists.offsets.to_numpy()).max(initial=0))
                    ready = (Cell(asks.column(0).to_numpy(), matrix(lists, dims), k), asks.column(2).to_numpy())
                if ready is not None:
                    lists = part.column(1)
                    dims = int(np.diff(lists.offsets.to_numpy()).max(initial=0))
                    ready[0].meet(part.column(0).to_numpy(), matrix(lists, dims))
        yield from results()

    found = in_arrow(rows, run, "query_id bigint, qkey bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("query_id", "qkey").orderBy(F.col("score").desc(), F.col("vec_id").asc())
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = written(quantised(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), "vectors")
    return top_k(vectors.where(F.pmod("id", F.lit(100)) == 0), vectors, 10)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum(list_transform(list_zip(q.v, c.v), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0)))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored)
SELECT query_id, r::INT AS rank, vec_id, score FROM ranked WHERE r <= 10
"""

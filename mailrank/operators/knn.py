"""Vector top-k: exact, over inverted-file cells, and over int8 codes.

One kernel does all three. It scores a batch of vectors against the query matrix
with a matrix product and keeps the best ``k`` per query, so a task hands on at most
``k`` rows per query however many vectors it reads. A rank window over those rows
gives the final list.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailrank.functions.vectors import cosine
from mailrank.operators.quantise import LEVELS
from mailrank.session import PUSHED_VALUES, fetch, fresh_path, settle

SCORE_DIGITS = 9  # scores are ranked after rounding, so the order of summing cannot show
QUERY_ROWS = 20_000  # query vectors sent to every worker,
QUERY_FLOATS = 16_000_000  # and numbers in them: 128 MB as doubles
CHUNK_ROWS = 8_192  # vectors a task holds while queries too many to send stream past,
BLOCK_QUERIES = 4_096  # and queries of a block
SCORES_AT_ONCE = 4_000_000


def top_k(
    scored: DataFrame,
    k: int,
    score: str = "score",
    limits: DataFrame | None = None,
    digits: int | None = SCORE_DIGITS,
) -> DataFrame:
    """Add ``rank`` per ``qid`` (best score first, then lowest ``doc_id``), keep ``k``.

    The literal bound lets every task drop all but its own best ``k`` before the
    shuffle. ``limits`` is ``(qid, max_results)`` for queries that want fewer than ``k``.
    """
    value = F.col(score) if digits is None else F.round(score, digits)
    order = Window.partitionBy("qid").orderBy(value.desc(), "doc_id")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    if limits is not None:
        ranked = ranked.join(limits.select("qid", "max_results"), "qid").where(
            F.col("rank") <= F.col("max_results")
        ).drop("max_results")
    return ranked


def _matrix(column) -> np.ndarray:
    """Equal-length list column to a 2-D array."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = values.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(values), -1) if len(values) else flat.reshape(0, 0)


def _unit(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    wide = matrix.astype(np.float64)
    size = np.sqrt((wide * wide).sum(axis=1))
    return wide / np.where(size > 0, size, 1.0)[:, None], size > 0


def _asked(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which queries have a vector, these as units, and which of them have a length."""
    sizes = pc.unique(pc.drop_null(pc.list_value_length(column))).to_pylist()
    if len(sizes) > 1:
        raise ValueError(f"queries of {sorted(sizes)} numbers")
    there = pc.is_valid(column)
    return there.to_numpy(), *_unit(_matrix(column.filter(there)))


@dataclass(frozen=True)
class Kernel:
    """What a task needs to score vectors: ``k``, how to read int8 codes, whether vectors
    of another length than the queries' are left out or end the job."""

    k: int
    lo: float | None = None
    step: float = 0.0
    drop_odd: bool = False

    def decode(self, matrix: np.ndarray) -> np.ndarray:
        return matrix if self.lo is None else self.lo + matrix.astype(np.float64) * self.step

    def fitting(self, column, dim: int) -> tuple[np.ndarray, np.ndarray]:
        """Which vectors are there and have ``dim`` numbers, and those as a matrix."""
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        sizes = pc.list_value_length(column)
        fits = pc.fill_null(pc.equal(sizes, dim), False)
        if not self.drop_odd and pc.any(pc.not_equal(sizes, dim)).as_py():
            odd = pc.unique(sizes.filter(pc.not_equal(sizes, dim))).to_pylist()
            raise ValueError(f"vectors of {odd} numbers against queries of {dim}")
        return fits.to_numpy(zero_copy_only=False), _matrix(column.filter(fits))

    def batch(self, ids, vectors, unit_queries):
        """Candidates ``(query, id, score)`` of one batch: at least each query's best ``k``."""
        if not len(ids) or not len(unit_queries):
            return _stack([])
        units, good = _unit(self.decode(vectors))
        units, ids = units[good], ids[good]
        found = []
        width = max(1, SCORES_AT_ONCE // max(1, len(ids)))
        for start in range(0, len(unit_queries), width):
            scores = np.round(units @ unit_queries[start : start + width].T, SCORE_DIGITS)
            if len(ids) > self.k:
                cut = np.partition(scores, len(ids) - self.k, axis=0)[len(ids) - self.k]
                at, query = np.nonzero(scores >= cut)
            else:
                at, query = np.nonzero(np.ones_like(scores, dtype=bool))
            # Equal scores can be many: prune before the next block is scored.
            found.append(self.prune(query + start, ids[at], scores[at, query]))
        return _stack(found)

    def prune(self, query, ids, scores):
        """Keep each query's best ``k``; ties go to the lower id."""
        order = np.lexsort((ids, -scores, query))
        query, ids, scores = query[order], ids[order], scores[order]
        first = np.searchsorted(query, query, side="left")
        keep = np.arange(len(query)) - first < self.k
        return query[keep], ids[keep], scores[keep]


def _stack(parts):
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(column) for column in zip(*parts))


def _scan(vectors: DataFrame, queries: pa.Table, kernel: Kernel, probes: pa.Table | None) -> DataFrame:
    """Score every vector in place against a query matrix that fits on a worker."""
    spark = vectors.sparkSession
    there, units, good = _asked(queries["vec"])
    qids = queries["qid"].to_numpy()[there][good]
    if not len(qids):
        # Nothing asks, so no vector is looked at.
        return spark.createDataFrame([], "qid BIGINT, doc_id BIGINT, score DOUBLE")
    wanted = None
    if probes is not None:
        place = {q: i for i, q in enumerate(qids.tolist())}
        wanted = {}
        for qid, cell in zip(probes["qid"].to_pylist(), probes["cell"].to_pylist()):
            if qid in place:
                wanted.setdefault(cell, []).append(place[qid])
        wanted = {cell: np.sort(np.asarray(rows)) for cell, rows in wanted.items()}
    sent = spark.sparkContext.broadcast((units[good], qids, wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit_queries, query_ids, by_cell = sent.value
        best = _stack([])
        for batch in batches:
            if not batch.num_rows:
                continue
            fits, matrix = kernel.fitting(batch.column(1), unit_queries.shape[1])
            ids = batch.column(0).to_numpy()[fits]
            if by_cell is None:
                parts = [kernel.batch(ids, matrix, unit_queries)]
            else:
                parts = []
                cells = batch.column(2).to_numpy()[fits]
                for cell in np.unique(cells):
                    rows, asking = cells == cell, by_cell.get(int(cell))
                    if asking is not None:
                        query, hit, score = kernel.batch(ids[rows], matrix[rows], unit_queries[asking])
                        parts.append((asking[query], hit, score))
            best = kernel.prune(*_stack([best, *parts]))
        query, ids, scores = best
        if len(query):
            yield pa.RecordBatch.from_arrays(
                [pa.array(query_ids[query].astype(np.int64)), pa.array(ids.astype(np.int64)), pa.array(scores)],
                names=["qid", "doc_id", "score"],
            )

    columns = ["doc_id", "vec"]
    if probes is not None:
        # Literal cell numbers prune partitions of a table written by cell.
        columns.append("cell")
        few = len(wanted) <= PUSHED_VALUES
        vectors = vectors.where(F.col("cell").isin(sorted(wanted)) if few else F.col("cell").between(min(wanted), max(wanted)))
    return vectors.select(*columns).mapInArrow(run, "qid BIGINT, doc_id BIGINT, score DOUBLE")


def _stored(folder: str, block_rows: int, columns: list[str]) -> Iterator[pa.Table]:
    """The rows of a table in the shared folder, a block at a time."""
    system, root = fs.FileSystem.from_uri(folder) if ":/" in folder else (fs.LocalFileSystem(), folder)
    for info in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        if info.is_file and info.path.endswith(".parquet"):
            with system.open_input_file(info.path) as file:
                for batch in pq.ParquetFile(file).iter_batches(block_rows, columns=columns):
                    yield pa.Table.from_batches([batch])


def _blocks(vectors: DataFrame, queries: DataFrame, kernel: Kernel, chunk_rows: int, block_queries: int) -> DataFrame:
    """Score two sides that are both large; only queries are copied.

    Queries are written to the shared folder, by ``cell`` where there are cells. A task reads
    its vectors once, in chunks, and lets the query files of a chunk's cells stream past each,
    a block at a time; it holds one chunk, one block and the best of that block. Vectors stay
    where they are, or with cells are shuffled once so that a task has few cells.
    """
    spark = vectors.sparkSession
    path = fresh_path(spark, "queries")
    celled = "cell" in vectors.columns
    if celled:
        queries.select("qid", "vec", "cell").hint("rebalance", "cell").write.partitionBy("cell").parquet(path)
        vectors = vectors.select("doc_id", "vec", "cell").hint("rebalance", "cell").sortWithinPartitions("cell")
    else:
        queries.select("qid", "vec").write.parquet(path)
        vectors = vectors.select("doc_id", "vec")

    def meet(chunk: pa.Table, folder: str) -> Iterator[pa.RecordBatch]:
        fitted = None
        for block in _stored(folder, block_queries, ["qid", "vec"]):
            there, units, good = _asked(block["vec"])
            if not good.any():
                continue
            if fitted is None or fitted[0] != units.shape[1]:
                fitted = units.shape[1], *kernel.fitting(chunk["vec"], units.shape[1])
            _, fits, matrix = fitted
            ids = chunk["doc_id"].to_numpy()[fits]
            query, hit, score = kernel.prune(*kernel.batch(ids, matrix, units[good]))
            if len(query):
                qids = block["qid"].to_numpy()[there][good]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(qids[query].astype(np.int64)), pa.array(hit.astype(np.int64)), pa.array(score)],
                    names=["qid", "doc_id", "score"],
                )

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= chunk_rows:
                yield pa.Table.from_batches(held)
                held, n = [], 0
        if n:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            if not celled:
                yield from meet(chunk, path)
                continue
            cells = chunk["cell"].to_numpy()
            for cell in np.unique(cells):
                yield from meet(chunk.filter(pa.array(cells == cell)), f"{path}/cell={int(cell)}")

    return vectors.mapInArrow(run, "qid BIGINT, doc_id BIGINT, score DOUBLE")


def _small_queries(queries: DataFrame, query_floats: int) -> pa.Table | None:
    """The query vectors as a local table, or None when they are more than the bound."""
    rows = min(QUERY_ROWS, query_floats)
    head = queries.select(F.col("qid").cast("bigint").alias("qid"), "vec").limit(rows + 1).toArrow()
    held = pc.sum(pc.list_value_length(head["vec"])).as_py() or 0
    return head if head.num_rows <= rows and held <= query_floats else None


def _candidates(vectors, queries, kernel, probes=None, query_floats=QUERY_FLOATS, **blocks):
    near = _small_queries(queries, query_floats)
    asked = None
    if near is not None and probes is not None:
        limit = query_floats // 16
        asked = probes.select(F.col("qid").cast("bigint").alias("qid"), "cell").limit(limit + 1).toArrow()
    if near is not None and (asked is None or asked.num_rows <= limit):
        return _scan(vectors, near, kernel, asked)
    queries = queries.select(F.col("qid").cast("bigint").alias("qid"), "vec")
    if probes is None:
        vectors = vectors.select("doc_id", "vec")
    else:
        queries = queries.join(probes.select(F.col("qid").cast("bigint").alias("qid"), "cell"), "qid")
    return _blocks(
        vectors, queries, kernel, blocks.get("chunk_rows", CHUNK_ROWS), blocks.get("block_queries", BLOCK_QUERIES)
    )


def knn(
    vectors: DataFrame,
    query_vectors: DataFrame,
    k: int,
    limits: DataFrame | None = None,
    query_floats: int = QUERY_FLOATS,
    drop_odd: bool = False,
    **blocks,
) -> DataFrame:
    """Exact cosine top-k: ``(qid, doc_id, score, rank)``.

    ``vectors`` is ``(doc_id, vec)``, ``query_vectors`` is ``(qid, vec)``. Every query gets
    its ``k`` nearest vectors however far they are; vectors of no length have no angle and
    are left out, and so are null ones. A vector of another length than the queries' ends
    the job, or with ``drop_odd`` is left out. ``query_floats`` bounds what is sent to every
    worker; more queries are read from the shared folder block by block, with the same result.
    """
    found = _candidates(vectors, query_vectors, Kernel(k, drop_odd=drop_odd), None, query_floats, **blocks)
    return top_k(found, k, limits=limits)


def probe_cells(centroids: DataFrame, query_vectors: DataFrame, nprobe: int) -> DataFrame:
    """``(qid, cell, rank)``: the cells nearest to each query."""
    cells = centroids.select(F.col("cell").cast("bigint").alias("doc_id"), F.col("center").alias("vec"))
    return knn(cells, query_vectors, nprobe).select("qid", F.col("doc_id").cast("int").alias("cell"), "rank")


def knn_ivf(
    vectors: DataFrame,
    centroids: DataFrame,
    query_vectors: DataFrame,
    k: int,
    nprobe: int,
    limits: DataFrame | None = None,
    query_floats: int = QUERY_FLOATS,
    drop_odd: bool = False,
    **blocks,
) -> DataFrame:
    """Top-k among the vectors of each query's ``nprobe`` nearest cells.

    ``vectors`` carries its ``cell``. With ``nprobe`` equal to the number of cells this is
    :func:`knn`, whose rules for null and odd vectors hold here too.
    """
    probes = probe_cells(centroids, query_vectors, nprobe)
    found = _candidates(vectors, query_vectors, Kernel(k, drop_odd=drop_odd), probes, query_floats, **blocks)
    return top_k(found, k, limits=limits)


def knn_int8(
    codes: DataFrame,
    bounds: tuple[float, float],
    query_vectors: DataFrame,
    k: int,
    vectors: DataFrame | None = None,
    oversample: int = 4,
    limits: DataFrame | None = None,
    centroids: DataFrame | None = None,
    nprobe: int = 1,
    query_floats: int = QUERY_FLOATS,
    **blocks,
) -> DataFrame:
    """Top-k over int8 codes ``(doc_id, codes)``.

    With ``vectors`` given, the best ``k * oversample`` by code are ranked again by their
    full vectors. With ``centroids`` given, ``codes`` carries its ``cell`` and only the
    ``nprobe`` nearest cells of a query are scored.
    """
    lo, hi = bounds
    take = k if vectors is None else k * oversample
    kernel = Kernel(take, lo, (hi - lo) / LEVELS)
    cell = ["cell"] if centroids is not None else []
    coded = codes.select("doc_id", F.col("codes").alias("vec"), *cell)
    probes = probe_cells(centroids, query_vectors, nprobe) if cell else None
    found = top_k(_candidates(coded, query_vectors, kernel, probes, query_floats, **blocks), take)
    if vectors is not None:
        asked = query_vectors.select(F.col("qid").cast("bigint").alias("qid"), F.col("vec").alias("_q"))
        queries = settle(asked, query_floats // 1_024).df
        score = F.round(cosine(F.col("vec"), F.col("_q")), SCORE_DIGITS)
        few = fetch(vectors.select("doc_id", "vec"), settle(found.select("qid", "doc_id")))
        found = few.join(queries, "qid").select("qid", "doc_id", score.alias("score"))
    return top_k(found.drop("rank"), k, limits=limits)

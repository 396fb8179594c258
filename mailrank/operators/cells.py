"""Two-level cells for approximate neighbour search: coarse centres, and finer ones inside each.

Only the coarse centres, at most ``MOST_COARSE``, ever reach the driver. The fine centres are a
table that grows with the vectors; vectors meet those of their own coarse cell, and a query those
of the coarse cells nearest to it. Centres are fitted on bounded samples by hash; every vector gets
its cell. How many cells a search looks into is measured: the exact neighbours of a bounded sample
of queries say at which rank of a query's cells its neighbours lie. What those cells leave out is
found too if asked for (``whole``): every further cell whose farthest vector leaves room for a
nearer neighbour is looked into, so the result is the exact one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailrank.functions.vectors import norm
from mailrank.operators.knn import (
    BLOCK_QUERIES, QUERY_FLOATS, SCORE_DIGITS, SCORES_AT_ONCE, Kernel, _asked, _candidates, _matrix, _stored, _unit, knn,
    knn_ivf, probe_cells, top_k,
)
from mailrank.session import fresh_path, settle

MOST_COARSE = 1_024
COARSE_SAMPLE = 100_000  # vectors the coarse centres are fitted on, about
CELL_ROWS = 1_000  # vectors of a fine cell, about
ROWS_PER_CENTRE = 64  # vectors a fine centre is fitted on,
FINE_SAMPLE = 50_000  # of at most as many in one coarse cell, about
FINE_BITS = 20  # a cell's number is that of its coarse cell and these bits
ROUNDS = 10
SENT_FLOATS = QUERY_FLOATS
RECALL_QUERIES = 200
ANGLE_SLACK = 1e-6  # radians, far above the error of an angle
_HASHES = 1 << 30


@dataclass(frozen=True)
class Cells:
    """``coarse`` is ``(cell, center)``, ``fine`` is ``(doc_id, vec, cell)`` with a fine cell's number and
    centre and its coarse cell, ``vectors`` is ``(doc_id, vec, coarse, cell)``."""

    coarse: DataFrame
    fine: DataFrame
    vectors: DataFrame

    def write(self, path: str) -> Cells:
        """Write the layout, ranged by cell, so that a cell lies in few files and few row groups of them."""
        spark = self.vectors.sparkSession
        self.coarse.write.mode("overwrite").parquet(f"{path}/coarse")
        self.fine.write.mode("overwrite").parquet(f"{path}/fine")
        ranged = self.vectors.repartitionByRange("cell", "doc_id").sortWithinPartitions("cell", "doc_id")
        ranged.write.mode("overwrite").parquet(f"{path}/vectors")
        return open_cells(spark, path)


def open_cells(spark: SparkSession, path: str) -> Cells:
    return Cells(*(spark.read.parquet(f"{path}/{name}") for name in ("coarse", "fine", "vectors")))


def _sampled(key: str, share) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(_HASHES)) < F.lit(_HASHES) * share


def _rows_at_once(n_centres: int) -> int:
    """Rows whose scores against all centres are held together: a bounded number of scores."""
    return min(4_096, max(1, SCORES_AT_ONCE // max(1, n_centres)))


def _nearest_in_place(rows: DataFrame, centres: list[tuple[int, int, list[float]]], name: str) -> DataFrame:
    """``rows`` with the number of the nearest of ``centres`` ``(group, number, center)``; rows of a group look at its centres."""
    by_group: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for group in sorted({g for g, _, _ in centres}):
        mine = sorted((n, c) for g, n, c in centres if g == group)
        by_group[group] = (np.array([n for n, _ in mine], np.int64), _unit(np.array([c for _, c in mine], np.float64))[0])
    sent = rows.sparkSession.sparkContext.broadcast(by_group)
    at = {c: i for i, c in enumerate(rows.columns)}
    grouped = "coarse" in at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            units, _ = _unit(_matrix(batch.column(at["vec"])))
            group = batch.column(at["coarse"]).to_numpy() if grouped else np.zeros(batch.num_rows, np.int64)
            out = np.zeros(batch.num_rows, np.int64)
            for g in np.unique(group):
                numbers, matrix = sent.value[int(g)]
                mine = np.flatnonzero(group == g)
                step = _rows_at_once(len(numbers))
                for a in range(0, len(mine), step):
                    some = mine[a : a + step]
                    # The first of equal ones has the lower number.
                    out[some] = numbers[np.argmax(np.round(units[some] @ matrix.T, SCORE_DIGITS), axis=1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out.astype(np.int32))], names=[*at, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{fields}, {name} int")


def _usable(vectors: DataFrame) -> DataFrame:
    return vectors.where(norm(F.col("vec")) > 0).select(F.col("doc_id").cast("bigint").alias("doc_id"), "vec")


def assign(vectors: DataFrame, coarse: DataFrame, fine: DataFrame, sent_floats: int = SENT_FLOATS) -> Cells:
    """Every vector of a length in its cell: the nearest fine one of the nearest coarse one.

    Fine centres of up to ``sent_floats`` numbers are sent to the vectors; more of them meet the
    vectors by coarse cell in a shuffle, with the same result.
    """
    near = _nearest_in_place(_usable(vectors), [(0, r.cell, r.center) for r in coarse.collect()], "coarse")
    n_fine, width = fine.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    if n_fine * (width or 0) <= sent_floats:
        centres = [(r.cell, r.doc_id, r.vec) for r in fine.collect()]
        return Cells(coarse, fine, _nearest_in_place(near, centres, "cell"))
    asked = near.select(F.col("doc_id").alias("qid"), "vec")
    homes = near.select(F.col("doc_id").alias("qid"), F.col("coarse").alias("cell"))
    found = top_k(_candidates(fine, asked, Kernel(1), homes, 0), 1)
    found = found.select(F.col("qid").alias("doc_id"), F.col("doc_id").cast("int").alias("cell"))
    return Cells(coarse, fine, near.join(found, "doc_id"))


def _lloyd(units: np.ndarray, n: int) -> np.ndarray:
    """Centres of ``n`` groups of unit vectors; starts from the first ``n`` distinct rows."""
    first = np.sort(np.unique(units, axis=0, return_index=True)[1])[:n]
    centres = units[first]
    for _ in range(ROUNDS):
        parts = range(0, len(units), _rows_at_once(len(centres)))
        near = np.concatenate([np.argmax(units[a : a + parts.step] @ centres.T, axis=1) for a in parts])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, units)
        sums, there = _unit(sums)
        # A centre that nothing is near to stays.
        moved = np.where(there[:, None], sums, centres)
        if np.allclose(moved, centres):
            break
        centres = moved
    return centres


def build_cells(vectors: DataFrame, n_coarse: int | None = None, cell_rows: int = CELL_ROWS, seed: int = 42) -> Cells:
    """Fit both levels on samples and give every vector of a length its cell.

    There are about as many fine cells as ``vectors / cell_rows`` and, unless given, the square
    root of that many coarse ones.
    """
    spark = vectors.sparkSession
    rows = _usable(vectors)
    n = rows.count()
    if not n:
        coarse = spark.createDataFrame([], "cell int, center array<double>")
        fine = spark.createDataFrame([], "doc_id int, vec array<double>, cell int")
        return Cells(coarse, fine, rows.withColumns({"coarse": F.lit(0), "cell": F.lit(0)}))
    if n_coarse is None:
        n_coarse = math.isqrt(max(1, n // cell_rows)) + 1
    n_coarse = min(n_coarse, MOST_COARSE, n)
    sample = rows.where(_sampled("doc_id", min(1.0, COARSE_SAMPLE / n)))
    features = sample.select(array_to_vector(F.col("vec").cast("array<double>")).alias("features"))
    if n_coarse > 1:
        means = KMeans(k=n_coarse, distanceMeasure="cosine", seed=seed, maxIter=ROUNDS).fit(features).clusterCenters()
    else:
        means = [np.array(sample.first().vec, np.float64)]
    coarse = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(means)], "cell int, center array<double>")
    near = _nearest_in_place(rows, [(0, r.cell, r.center) for r in coarse.collect()], "coarse")
    held = near.groupBy("coarse").agg(F.count(F.lit(1)).alias("held"))
    wanted = F.least(F.greatest(F.ceil(F.col("held") / cell_rows), F.lit(1)), F.lit((1 << FINE_BITS) - 1))
    take = F.least(F.col("held"), wanted * ROWS_PER_CENTRE, F.lit(FINE_SAMPLE))
    # As many rows as coarse cells.
    sizes = F.broadcast(held.select("coarse", wanted.cast("int").alias("n_fine"), (take / F.col("held")).alias("share")))
    picked = near.join(sizes, "coarse").where(_sampled("doc_id", F.col("share")) | (F.col("share") >= 1))
    # A coarse cell whose sample came out empty still has its coarse centre.
    own = coarse.select(F.col("cell").alias("coarse"), F.col("center").alias("vec"), F.lit(-1).cast("bigint").alias("doc_id"), F.lit(0).alias("n_fine"))
    picked = picked.select("coarse", F.col("vec").cast("array<double>").alias("vec"), "doc_id", "n_fine").unionByName(own)

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("doc_id")
        cell = int(group.coarse.iloc[0])
        mine = group[group.doc_id >= 0] if (group.doc_id >= 0).any() else group
        units = _unit(np.stack(mine.vec.to_numpy()).astype(np.float64))[0]
        centres = _lloyd(units, max(1, int(mine.n_fine.max())))
        return pd.DataFrame({"doc_id": (cell << FINE_BITS) + np.arange(len(centres)), "vec": list(centres), "cell": cell})

    fine = picked.groupBy("coarse").applyInPandas(fit, "doc_id int, vec array<double>, cell int")
    return assign(vectors, coarse, fine)


def probed(cells: Cells, query_vectors: DataFrame, nprobe: int, coarse_probes: int) -> DataFrame:
    """``(qid, cell, rank)``: the fine cells nearest to each query, of its nearest coarse cells."""
    near = knn_ivf(cells.fine, cells.coarse, query_vectors, nprobe, coarse_probes)
    return near.select("qid", F.col("doc_id").cast("int").alias("cell"), "rank")


def cell_reach(cells: Cells) -> DataFrame:
    """``(cell, center, reach)`` of the fine cells that hold vectors: the cosine of the centre and the vector farthest from it."""
    centres = cells.fine.select(F.col("doc_id").cast("int").alias("cell"), F.col("vec").alias("center"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            one, other = (_unit(_matrix(batch.column(c)))[0] for c in (1, 2))
            cosines = np.nan_to_num((one * other).sum(axis=1), nan=-1.0)
            numbers, at = np.unique(batch.column(0).to_numpy(), return_inverse=True)
            reach = np.ones(len(numbers))
            np.minimum.at(reach, at, cosines)
            yield pa.RecordBatch.from_arrays([pa.array(numbers.astype(np.int32)), pa.array(reach)], names=["cell", "reach"])

    met = cells.vectors.select(F.col("cell").cast("int").alias("cell"), "vec").join(centres, "cell")
    held = met.mapInArrow(run, "cell int, reach double").groupBy("cell").agg(F.min("reach").alias("reach"))
    return centres.join(held, "cell")


def _open_cells(reach: DataFrame, asked: DataFrame) -> DataFrame:
    """``(qid, cell)`` of the cells that may hold a vector as near as ``floor`` to a query of ``(qid, vec, floor)``.

    A vector is at least the angle between query and centre less the cell's own from the query.
    Queries are read from the shared folder, block by block, so no more than a block is held.
    """
    path = fresh_path(asked.sparkSession, "floors")
    asked.select("qid", "vec", "floor").write.parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            numbers, (units, _) = batch.column(0).to_numpy(), _unit(_matrix(batch.column(1)))
            wide = np.arccos(np.clip(batch.column(2).to_numpy(), -1, 1)) + ANGLE_SLACK
            for block in _stored(path, BLOCK_QUERIES, ["qid", "vec", "floor"]):
                there, queries, good = _asked(block["vec"])
                qids, floors = (block[c].to_numpy()[there][good] for c in ("qid", "floor"))
                queries = queries[good]
                step = _rows_at_once(len(queries))
                for a in range(0, len(numbers) if len(queries) else 0, step):
                    angles = np.arccos(np.clip(units[a : a + step] @ queries.T, -1, 1)) - wide[a : a + step, None]
                    cell, query = np.nonzero(~(np.cos(np.maximum(angles, 0)) < floors))
                    if len(cell):
                        columns = [pa.array(qids[query].astype(np.int64)), pa.array(numbers[cell + a].astype(np.int32))]
                        yield pa.RecordBatch.from_arrays(columns, names=["qid", "cell"])

    return reach.select("cell", "center", "reach").mapInArrow(run, "qid bigint, cell int")


def knn_cells(
    cells: Cells, query_vectors: DataFrame, k: int, nprobe: int, coarse_probes: int,
    limits: DataFrame | None = None, query_floats: int = QUERY_FLOATS, whole: bool = False, **blocks,
) -> DataFrame:
    """Top-k among the vectors of each query's ``nprobe`` nearest cells; like ``knn`` once they are all cells.

    With ``whole`` it is like ``knn`` for any number of them: the ``k``-th score of these cells says
    which of the others may still hold a better one, and those are looked into as well.
    """
    probes = probed(cells, query_vectors, nprobe, coarse_probes)
    if not whole:
        found = _candidates(cells.vectors, query_vectors, Kernel(k), probes, query_floats, **blocks)
        return top_k(found, k, limits=limits)
    probes = settle(probes.select("qid", "cell")).df
    first = settle(top_k(_candidates(cells.vectors, query_vectors, Kernel(k), probes, query_floats, **blocks), k)).df
    # Scores are rounded; a query that found fewer than k may want any cell.
    floors = first.where(F.col("rank") == k).select("qid", (F.col("score") - 10.0**-SCORE_DIGITS).alias("floor"))
    asked = query_vectors.select(F.col("qid").cast("bigint").alias("qid"), "vec").join(floors, "qid", "left")
    opened = _open_cells(cell_reach(cells), asked.withColumn("floor", F.coalesce("floor", F.lit(-2.0))))
    rest = settle(opened.join(probes, ["qid", "cell"], "left_anti")).df
    more = _candidates(cells.vectors, query_vectors, Kernel(k), rest, query_floats, **blocks)
    return top_k(first.drop("rank").unionByName(more), k, limits=limits)


def _rank_for(ranks: np.ndarray, share: float, most: int) -> int:
    """The rank up to which a share of ``ranks`` (infinite where not met) lies."""
    if not len(ranks):
        return 1
    at = np.sort(ranks)[max(0, math.ceil(share * len(ranks)) - 1)]
    return most if np.isinf(at) else int(at)


def choose_probes(cells: Cells, query_vectors: DataFrame, k: int, recall: float = 0.9) -> tuple[int, int, float]:
    """``(nprobe, coarse_probes, recall)``: the fewest cells that hold ``recall`` of the exact neighbours.

    Measured against brute force with at most ``RECALL_QUERIES`` of the queries, those of the
    smallest hash; all vectors take part. Half of what may be lost is left to the coarse level.
    """
    asked = query_vectors.where(F.col("vec").isNotNull()).orderBy(F.xxhash64("qid"), "qid").limit(RECALL_QUERIES)
    exact = knn(cells.vectors.select("doc_id", "vec"), asked, k).select("qid", "doc_id")
    homes = cells.vectors.select("doc_id", "coarse", "cell")
    near = exact.join(homes, "doc_id")
    n_coarse, n_fine = cells.coarse.count(), cells.fine.count()
    by_coarse = probe_cells(cells.coarse, asked, n_coarse).select("qid", F.col("cell").alias("coarse"), "rank")
    found = near.join(by_coarse, ["qid", "coarse"], "left").select(F.col("rank").cast("double")).toArrow()["rank"]
    coarse_probes = _rank_for(np.nan_to_num(found.to_numpy(), nan=np.inf), (1 + recall) / 2, n_coarse)
    by_cell = probed(cells, asked, n_fine, coarse_probes)
    found = near.join(by_cell, ["qid", "cell"], "left").select(F.col("rank").cast("double")).toArrow()["rank"]
    ranks = np.nan_to_num(found.to_numpy(), nan=np.inf)
    nprobe = _rank_for(ranks, recall, n_fine)
    return nprobe, coarse_probes, float((ranks <= nprobe).mean()) if len(ranks) else 1.0

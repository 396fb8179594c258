"""A compact vector index: int8 codes laid out by nearest centre, for the vector leg."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from mailrank.operators.ivf import build_ivf, read_ivf, write_ivf
from mailrank.operators.knn import knn_int8
from mailrank.operators.quantise import quantise_int8, value_bounds
from mailrank.plans.search import VectorLeg


@dataclass(frozen=True)
class VectorIndex:
    """``cells`` is ``(doc_id, codes, cell)``; ``bounds`` is the value range the codes span."""

    centroids: DataFrame
    cells: DataFrame
    bounds: tuple[float, float]

    def leg(self, nprobe: int, vectors: DataFrame | None = None, oversample: int = 4) -> VectorLeg:
        """The vector leg of a hybrid search over ``nprobe`` cells per query.

        With the full ``vectors`` given, the best by code are ranked again by them.
        """

        def search(query_vectors, k, limits):
            return knn_int8(
                self.cells, self.bounds, query_vectors, k, vectors=vectors, oversample=oversample,
                limits=limits, centroids=self.centroids, nprobe=nprobe,
            )

        return search


def build_vector_index(
    vectors: DataFrame,
    path: str,
    n_cells: int | None = None,
    confidence: float = 1.0,
) -> VectorIndex:
    """Quantise and group ``(doc_id, vec)``, write the result below ``path`` and open it."""
    spark = vectors.sparkSession
    centroids, cells = build_ivf(vectors, n_cells)
    bounds = value_bounds(vectors, confidence)
    write_ivf(centroids, quantise_int8(cells, bounds, keep=("cell",)), path)
    spark.createDataFrame([bounds], "lo DOUBLE, hi DOUBLE").write.mode("overwrite").parquet(f"{path}/bounds")
    return open_vector_index(spark, path)


def open_vector_index(spark: SparkSession, path: str) -> VectorIndex:
    centroids, cells = read_ivf(spark, path)
    return VectorIndex(centroids, cells, tuple(spark.read.parquet(f"{path}/bounds").first()))

"""Inverted-file layout for approximate neighbour search: vectors grouped by nearest centre."""

from __future__ import annotations

import math

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailrank.functions.vectors import norm


def build_ivf(
    vectors: DataFrame,
    n_cells: int | None = None,
    seed: int = 42,
    max_iter: int = 10,
) -> tuple[DataFrame, DataFrame]:
    """``(centroids(cell, center), vectors(doc_id, vec, cell))``.

    Centres come from k-means on cosine distance; every vector is then given to its
    nearest centre. ``n_cells`` defaults to the square root of the number of vectors.
    Vectors of no length have no nearest centre and are left out.
    """
    spark = vectors.sparkSession
    usable = vectors.where(norm(F.col("vec")) > 0).select("doc_id", "vec")
    if n_cells is None:
        n_cells = max(2, math.isqrt(usable.count()))
    features = usable.withColumn("features", array_to_vector(F.col("vec").cast("array<double>")))
    means = KMeans(k=n_cells, distanceMeasure="cosine", seed=seed, maxIter=max_iter, predictionCol="cell")
    model = means.fit(features)
    centers = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    centroids = spark.createDataFrame(centers, "cell INT, center ARRAY<DOUBLE>")
    return centroids, model.transform(features).select("doc_id", "vec", "cell")


def write_ivf(centroids: DataFrame, cells: DataFrame, path: str) -> None:
    """Write the layout partitioned by cell; a cell that holds much is split over files."""
    centroids.write.mode("overwrite").parquet(f"{path}/centroids")
    cells.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/cells")


def read_ivf(spark, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/centroids"), spark.read.parquet(f"{path}/cells")

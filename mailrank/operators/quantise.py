"""int8 scalar quantisation of vectors: a quarter of the size, one scale for all values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = 127  # 7-bit codes


def value_bounds(vectors: DataFrame, confidence: float = 1.0, accuracy: int = 10_000) -> tuple[float, float]:
    """The value range the codes span.

    ``confidence`` 1 takes the exact smallest and largest value; less takes the quantiles
    that leave out ``1 - confidence`` of the values, half at each end. Without any value the
    range is ``(0, 0)``.
    """
    if confidence >= 1.0:
        row = vectors.agg(F.min(F.array_min("vec")), F.max(F.array_max("vec"))).first()
        return (0.0, 0.0) if row[0] is None else (float(row[0]), float(row[1]))
    tail = (1.0 - confidence) / 2
    values = vectors.select(F.explode("vec").alias("x"))
    found = values.agg(F.percentile_approx("x", [tail, 1.0 - tail], accuracy)).first()[0]
    return (0.0, 0.0) if found is None else (float(found[0]), float(found[1]))


def quantise_int8(vectors: DataFrame, bounds: tuple[float, float], keep: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, codes ARRAY<TINYINT>)``; values outside the bounds take the nearest one."""
    lo, hi = (F.lit(float(b)) for b in bounds)
    scale = LEVELS / (bounds[1] - bounds[0]) if bounds[1] > bounds[0] else 0.0

    def code(x):
        clipped = F.least(F.greatest(x.cast("double"), lo), hi)
        return F.floor((clipped - lo) * scale + 0.5).cast("tinyint")

    return vectors.select("doc_id", F.transform("vec", code).alias("codes"), *keep)


def dequantise(codes: DataFrame, bounds: tuple[float, float]) -> DataFrame:
    """Codes back to ``(doc_id, vec)``."""
    lo, hi = bounds
    step = (hi - lo) / LEVELS
    return codes.select(
        "doc_id", F.transform("codes", lambda c: (lo + c.cast("double") * step).cast("float")).alias("vec")
    )


def quantisation_error(vectors: DataFrame, codes: DataFrame, bounds: tuple[float, float]) -> DataFrame:
    """One row: how far the codes are from the vectors, and the bytes saved."""
    lo, hi = bounds
    step = (hi - lo) / LEVELS
    gaps = F.zip_with("vec", "codes", lambda x, c: F.abs(x.cast("double") - (lo + c.cast("double") * step)))
    each = vectors.join(codes, "doc_id").select(
        F.array_max(gaps).alias("worst"),
        F.aggregate(gaps, F.lit(0.0), lambda acc, x: acc + x).alias("total"),
        F.size("vec").alias("n"),
    )
    return each.agg(
        F.count(F.lit(1)).alias("n_vectors"),
        F.max("worst").alias("max_error"),
        (F.sum("total") / F.sum("n")).alias("mean_error"),
        (F.sum("n") * 4).alias("float_bytes"),
        F.sum("n").alias("code_bytes"),
    )

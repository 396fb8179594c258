"""Column functions over ``ARRAY<FLOAT>`` vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailrank.functions.binding import let
from mailrank.functions.text import blank

# Fixed values.
VECTOR_DIM = 768
HASH_BYTES = 32
TINY_NORM = 1e-12


def norm(v: Column) -> Column:
    squares = F.transform(v, lambda x: x.cast("double") * x.cast("double"))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x))


def l2_normalise(v: Column) -> Column:
    """Unit-length copy of a vector; a vector of (almost) no length stays as it is."""
    return let(
        norm(v),
        lambda n: F.when(n < TINY_NORM, v.cast("array<float>")).otherwise(
            F.transform(v, lambda x: (x / n).cast("float"))
        ),
    )


def zero_vector(dim: int = VECTOR_DIM) -> Column:
    return F.array_repeat(F.lit(0.0).cast("float"), dim)


def hash_embedding(c: Column, dim: int = VECTOR_DIM) -> Column:
    """Deterministic unit vector from the SHA-256 of a text; blank text gives zeros.

    Element ``i`` is byte ``i mod 32`` scaled to [-1, 1]. The 32 different values are
    scaled and normalised once, then repeated, with no Python in the path.
    """
    digest = F.sha2(c.cast("binary"), 256)
    values = let(
        digest,
        lambda h: F.transform(
            F.sequence(F.lit(0), F.lit(HASH_BYTES - 1)),
            lambda i: F.conv(F.substr(h, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255 * 2 - 1,
        ),
    )
    rounds, rest = divmod(dim, HASH_BYTES)

    def spread(block):
        times = F.transform(
            block, lambda x, i: x * x * (F.when(i < rest, rounds + 1).otherwise(rounds))
        )
        size = F.sqrt(F.aggregate(times, F.lit(0.0), lambda acc, x: acc + x))
        return let(
            size,
            lambda n: F.transform(
                block, lambda x: F.when(n < TINY_NORM, x).otherwise(x / n).cast("float")
            ),
        )

    full = F.slice(F.flatten(F.array_repeat(let(values, spread), rounds + 1)), 1, dim)
    return F.when(blank(c), zero_vector(dim)).otherwise(full)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of the angle between two vectors; null when either has no length."""
    dot = F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )
    size = norm(a) * norm(b)
    return F.when(size > 0, dot / size)

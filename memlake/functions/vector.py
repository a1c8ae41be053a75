"""Vector expressions over ``array<float>`` columns; arithmetic is done in DOUBLE."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for a zero vector or unequal lengths, null for a null vector."""
    size = norm(a) * norm(b)
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).otherwise(
        F.when((F.size(a) != F.size(b)) | (size == 0), F.lit(0.0)).otherwise(dot(a, b) / size)
    )


def literal(vector: Sequence[float]) -> Column:
    """A vector known on the driver, such as an embedded query."""
    return F.array(*[F.lit(float(x)) for x in vector])


def normalise(a: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    size = norm(a)
    return F.when(size == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(
        F.transform(a, lambda x: x.cast("double") / size)
    )


def softmax(scores: Column, temperature: float) -> Column:
    """Membership shares of an array of scores."""
    top = F.array_max(scores)
    powers = F.transform(scores, lambda s: F.exp((s - top) / temperature))
    total = F.aggregate(powers, F.lit(0.0), lambda s, x: s + x)
    return F.transform(powers, lambda x: x / total)
